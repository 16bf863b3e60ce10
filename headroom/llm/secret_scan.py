"""Secrets in texts: all rules compiled into one automaton that reads every byte once.

A rule is a head, a regular expression, and a tail, a byte class that repeats.  All rules become one
nondeterministic automaton that may start anywhere: a head and the first byte of its tail, or the
least number of tail bytes where there is no head.  Subset construction and minimisation turn it
into a transition array over byte classes.  The automaton runs over many stretches of text in step,
as array lookups, and flags the stretches that hold a candidate of a kind.  A stretch ends at a byte
after which every state is the start state, so no match reaches over it.

Flagged stretches, and they alone, are walked again for the kinds flagged, with the automaton of
the bare rule, to place its leftmost matches that don't overlap; matches that are too short are
dropped, as they would be by a regular-expression search followed by a filter.

Null and empty texts have no spans; a text of any length is one array of bytes, read once.  Rows are independent.
An input column named like ``output`` gives way to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from headroom.llm import words
from headroom.llm.aside import Aside


@dataclass(frozen=True)
class Rule:
    """``least`` counts the characters of the tail, or of the whole match if ``whole``."""

    kind: str
    head: str
    tail: str
    least: int
    whole: bool = True
    any_case: bool = False


#: The kinds that every scan reports.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", "[A-Za-z0-9+/_.=-]", 6, whole=False, any_case=True),
    Rule("access", "AKIA", "[A-Z0-9]", 20),
    Rule("hex", "", "[0-9a-f]", 24),
)
#: Further kinds: tokens with a prefix of their own.
MORE_RULES = (
    Rule("github", "gh[pousr]_", "[A-Za-z0-9]", 40),
    Rule("chat", "xox[abprs]-", "[A-Za-z0-9-]", 15),
)
RULES = BASE_RULES + MORE_RULES


class Nfa:
    """Nondeterministic automaton over bytes, built from patterns with ``| ( ) [ ] ? * +`` and escapes."""

    def __init__(self):
        self.free: list[list[int]] = []
        self.by_byte: list[tuple[np.ndarray, int] | None] = []

    def state(self) -> int:
        self.free.append([])
        self.by_byte.append(None)
        return len(self.free) - 1

    def add(self, pattern: str, start: int, any_case: bool) -> int:
        """Lay out a pattern from ``start`` on; returns its last state."""
        end, rest = self._choice(pattern, start, any_case)
        if rest:
            raise ValueError(f"unbalanced pattern at {rest!r}")
        return end

    def step(self, start: int, accepted: np.ndarray) -> int:
        one, end = self.state(), self.state()
        self.free[start].append(one)
        self.by_byte[one] = (accepted, end)
        return end

    def _choice(self, rest: str, start: int, any_case: bool) -> tuple[int, str]:
        end = self.state()
        while True:
            branch = self.state()
            self.free[start].append(branch)
            while rest and rest[0] not in "|)":
                branch, rest = self._item(rest, branch, any_case)
            self.free[branch].append(end)
            if not rest.startswith("|"):
                return end, rest
            rest = rest[1:]

    def _item(self, rest: str, start: int, any_case: bool) -> tuple[int, str]:
        first = self.state()
        self.free[start].append(first)
        if rest[0] == "(":
            end, rest = self._choice(rest[1:], first, any_case)
            rest = rest[1:]
        else:
            accepted, rest = _byte_class(rest) if rest[0] == "[" else _one_byte(rest)
            if any_case:
                lower, upper = accepted[0x61:0x7B], accepted[0x41:0x5B]
                accepted[0x61:0x7B] = accepted[0x41:0x5B] = lower | upper
            end = self.step(first, accepted)
        if rest[:1] in ("?", "*", "+") and rest:
            mark, rest = rest[0], rest[1:]
            if mark in "?*":
                self.free[first].append(end)
            if mark in "*+":
                after = self.state()
                self.free[end] += [first, after]
                end = after
        return end, rest

    def closure(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for other in self.free[todo.pop()]:
                if other not in seen:
                    seen.add(other)
                    todo.append(other)
        return frozenset(seen)


def _one_byte(rest: str) -> tuple[np.ndarray, str]:
    accepted = np.zeros(256, dtype=bool)
    if rest.startswith("\\x"):
        accepted[int(rest[2:4], 16)] = True
        return accepted, rest[4:]
    skip = 1 if rest[0] == "\\" else 0
    accepted[ord(rest[skip])] = True
    return accepted, rest[skip + 1 :]


def _byte_class(rest: str) -> tuple[np.ndarray, str]:
    inside, _, rest = rest[1:].partition("]")
    accepted = np.zeros(256, dtype=bool)
    while inside:
        if len(inside) > 2 and inside[1] == "-":
            accepted[ord(inside[0]) : ord(inside[2]) + 1] = True
            inside = inside[3:]
        else:
            one, inside = _one_byte(inside)
            accepted |= one
    return accepted, rest


@dataclass
class Dfa:
    """``table[state, byte_class[byte]]`` is the next state, 0 the start; ``flags`` has bits by state."""

    byte_class: np.ndarray
    table: np.ndarray
    flags: np.ndarray
    resets: np.ndarray


def determinise(nfa: Nfa, start: set[int], marks: dict[int, int], anywhere: bool) -> Dfa:
    """Subset construction, then merging of states that no input tells apart.

    ``marks`` has the flag bits of accepting states; ``anywhere`` lets a match begin at any byte.
    """
    sets = np.array([s[0] for s in nfa.by_byte if s is not None]).T
    _, byte_class = np.unique(sets, axis=0, return_inverse=True)
    byte_class = byte_class.ravel().astype(np.int32)
    samples = [int(np.flatnonzero(byte_class == c)[0]) for c in range(byte_class.max() + 1)]
    base = nfa.closure(start)
    number = {base: 0}
    order, rows = [base], []
    for subset in order:
        moving = [nfa.by_byte[s] for s in subset if nfa.by_byte[s] is not None]
        row = []
        for byte in samples:
            reached = {end for accepted, end in moving if accepted[byte]}
            target = nfa.closure(reached | (start if anywhere else set()))
            if target not in number:
                number[target] = len(order)
                order.append(target)
            row.append(number[target])
        rows.append(row)
    table = np.array(rows)
    flags = np.array([sum({marks[s] for s in subset if s in marks}) for subset in order])
    _, part = np.unique(flags, return_inverse=True)
    while True:
        _, finer = np.unique(np.column_stack([part, part[table]]), axis=0, return_inverse=True)
        finer = finer.ravel()
        if finer.max() == part.max():
            break
        part = finer
    first = np.array([np.flatnonzero(part == p)[0] for p in range(part.max() + 1)])
    # the start state is number 0
    rename = np.arange(len(first))
    rename[[0, part[0]]] = rename[[part[0], 0]]
    source = first[rename]
    table = rename[part[table[source]]].astype(np.int32)
    resets = (table == 0).all(axis=0)[byte_class]
    return Dfa(byte_class, table, flags[source].astype(np.int64), resets)


def combined(rules: tuple[Rule, ...]) -> Dfa:
    """One automaton for all rules; bit r is set where rule r may have a match."""
    nfa = Nfa()
    start, marks = nfa.state(), {}
    for r, rule in enumerate(rules):
        end = nfa.add(rule.head, start, rule.any_case)
        tail, _ = _byte_class(rule.tail)
        # counting behind a head multiplies states; a head and one byte is rare enough
        for _ in range(1 if rule.head else rule.least):
            end = nfa.step(end, tail)
        marks[end] = 1 << r
    return determinise(nfa, {start}, marks, anywhere=True)


def bare(rule: Rule) -> Dfa:
    """The rule from a given start: bit 0 where the head is complete, bit 1 where the tail has begun."""
    nfa = Nfa()
    start = nfa.state()
    end = nfa.add(rule.head, start, rule.any_case)
    tail, _ = _byte_class(rule.tail)
    after = nfa.step(end, tail)
    nfa.free[after].append(end_loop := nfa.state())
    nfa.by_byte[end_loop] = (tail, after)
    return determinise(nfa, {start}, {end: 1, after: 2}, anywhere=False)


class Scanner:
    #: Below so many stretches at once, bytes are read one at a time.
    FEW = 24

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.all = combined(rules)
        self.each = [bare(rule) for rule in rules]
        self.walks = [(d.table[:, d.byte_class].tolist(), d.flags.tolist(), self._dead(d)) for d in self.each]
        self.width = self.all.table.shape[1]
        self.steps = (self.all.table * self.width).ravel().astype(np.int32)
        self.flag_of = np.repeat(self.all.flags, self.width)
        self.lists = self.steps.tolist(), self.flag_of.tolist()

    @staticmethod
    def _dead(dfa: Dfa) -> int:
        """The state without a way out, or -1."""
        loops = np.flatnonzero((dfa.table == np.arange(len(dfa.table))[:, None]).all(axis=1) & (dfa.flags == 0))
        return int(loops[0]) if len(loops) else -1

    def stretches(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of runs of bytes that no match reaches over."""
        cut = np.zeros(len(data) + 1, dtype=bool)
        cut[1:] = self.all.resets[data]
        cut[offsets] = True
        cut[0] = True
        edges = np.flatnonzero(cut)
        return edges[:-1], edges[1:]

    def flagged(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The one pass over all bytes: stretches with matches, and the bits of their kinds."""
        starts, ends = self.stretches(data, offsets)
        order = np.argsort(starts - ends, kind="stable")
        starts, lengths = starts[order], (ends - starts)[order]
        kinds = np.zeros(len(starts), dtype=np.int64)
        state = np.zeros(len(starts), dtype=np.int32)
        classes = self.all.byte_class[data]
        longest = int(lengths[0]) if len(lengths) else 0
        active = len(lengths) - np.searchsorted(lengths[::-1], np.arange(longest), side="right")
        for t in range(longest):
            m = int(active[t])
            if m < self.FEW:
                self._finish(classes, starts[:m], lengths[:m], state, kinds, t)
                break
            now = self.steps[state[:m] + classes[starts[:m] + t]]
            state[:m] = now
            seen = self.flag_of[now]
            if seen.any():
                kinds[:m] |= seen
        hit = np.flatnonzero(kinds)
        hit = hit[np.argsort(starts[hit])]
        return starts[hit], starts[hit] + lengths[hit], kinds[hit]

    def _finish(self, classes, starts, lengths, state, kinds, t: int) -> None:
        steps, flag_of = self.lists
        for lane, (start, length) in enumerate(zip(starts.tolist(), lengths.tolist(), strict=True)):
            now, seen = int(state[lane]), 0
            for c in classes[start + t : start + length].tolist():
                now = steps[now + c]
                seen |= flag_of[now]
            kinds[lane] |= seen

    def matches(self, r: int, stretch: bytes) -> list[tuple[int, int]]:
        """Leftmost matches of one rule that don't overlap, without those that are too short."""
        table, flags, dead = self.walks[r]
        rule, out, at, n = self.rules[r], [], 0, len(stretch)
        while at < n:
            state, value, end, i = 0, -1, -1, at
            while i < n:
                was_head = flags[state] & 1
                state = table[state][stretch[i]]
                if state == dead:
                    break
                i += 1
                if flags[state] & 2:
                    end = i
                    if value < 0 and (was_head or not rule.head):
                        value = i - 1
            if end < 0:
                at += 1
                continue
            if end - (at if rule.whole else value) >= rule.least:
                out.append((at, end))
            at = end
        return out

    def spans(self, texts: pa.LargeStringArray) -> dict[int, list[tuple[int, int, int]]]:
        """For each text with secrets: (start, rule number, end) in code points, in order."""
        data, offsets = words.buffers(texts)
        found: dict[int, list] = {}
        starts, ends, kinds = self.flagged(data, offsets)
        text_of = np.searchsorted(offsets, starts, side="right") - 1
        for t, start, end, bits in zip(text_of.tolist(), starts.tolist(), ends.tolist(), kinds.tolist(), strict=True):
            stretch = data[start:end].tobytes()
            shift = start - int(offsets[t])
            for r in range(len(self.rules)):
                if bits >> r & 1:
                    found.setdefault(t, []).extend((a + shift, r, b + shift) for a, b in self.matches(r, stretch))
        for t, spans in found.items():
            point = np.concatenate([[0], np.cumsum((data[offsets[t] : offsets[t + 1]] & 0xC0) != 0x80)])
            found[t] = sorted((int(point[a]), r, int(point[b])) for a, r, b in spans)
        return {t: spans for t, spans in found.items() if spans}


def _scan(df: DataFrame, rules: tuple[Rule, ...], text: str, keep: list[str], columns, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = words.kept_in_process(f"secrets {rules}", lambda: Scanner(rules))
        for batch in batches:
            for block in words.blocks(batch, text):
                spans = scanner.spans(words.strings(block, text))
                kept = [block.column(block.schema.get_field_index(name)) for name in keep]
                made = columns([spans.get(t, []) for t in range(block.num_rows)])
                yield pa.RecordBatch.from_arrays([*kept, *made.values()], names=[*keep, *made])

    return df.mapInArrow(run, schema)


def _listed(spans, rules) -> str:
    return ",".join(f"{rules[r].kind}:{a}:{b}" for a, r, b in spans)


def find_secrets(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", output: str = "secrets") -> DataFrame:
    """All columns and ``secrets``: structs of kind, start and stop (code points, stop exclusive)."""
    own = Aside(df)
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))

    def columns(found):
        return {output: pa.array([[{"kind": rules[r].kind, "start": a, "stop": b} for a, r, b in spans] for spans in found], kind)}

    schema = T.StructType([*own.rows.schema.fields, T.StructField(output, T.ArrayType(span))])
    return own.back(_scan(own.rows, rules, own.of(text), own.numbers, columns, schema), output)


def secret_report(df: DataFrame, key: str = "doc_id", text: str = "text", more: tuple[Rule, ...] = MORE_RULES) -> DataFrame:
    """Per text: how many base secrets of each kind, a digest of their places, and all places."""
    rules = BASE_RULES + tuple(more)
    base = range(len(BASE_RULES))

    def columns(found):
        made = {f"n_{BASE_RULES[k].kind}": pa.array([sum(r == k for _, r, _ in spans) for spans in found], pa.int64()) for k in base}
        own = [_listed([s for s in spans if s[1] in base], rules) for spans in found]
        made["base_sha256"] = pa.array([hashlib.sha256(s.encode()).hexdigest() for s in own])
        made["spans"] = pa.array([_listed(spans, rules) for spans in found], pa.string())
        return made

    schema = f"{key} bigint, " + ", ".join(f"n_{r.kind} bigint" for r in BASE_RULES) + ", base_sha256 string, spans string"
    return _scan(df.select(key, text), rules, text, [key], columns, schema)
