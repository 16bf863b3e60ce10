"""Benchmark passages in documents, found by a generalised suffix automaton.

The items' words build one automaton, whose states stand for all runs of words that occur in some
item.  A document's words stream through it, and at each word the state and the length tell the
longest run ending there that an item has too.  Runs of at least ``window`` words are hits, and so
is the whole of an item that is shorter.

Only stretches of a document that can hold a hit enter the automaton: a block's words are hashed
together, and a stretch breaks wherever two neighbours stand side by side in no item.

The items are broadcast in shards of about ``SHARD_WORDS`` words, and every document passes through
one automaton after the other, without a shuffle; an item longer than that makes a shard of its
own size.  After every ``CHAINED`` shards the table is written, so driver and tasks hold no more of a
benchmark at once, however large it is.  The shards of one pass, and the cutting after the last, share a Python
worker, as Spark starts one more for every further step in Python and keeps it with its memory for later stages.
A process builds a shard's automaton once.

Null texts and empty texts have no words; null items and items without words match nothing.
Repeated items count once by their id, items without id are hit but not listed.  Repeated documents
are independent rows.  Input columns named like an added one give way to it in ``find_hits``; ``remove_hits``
leaves all but the text as they are.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from headroom.llm import words
from headroom.llm.aside import Aside
from headroom.sources.staging import stage

SHARD_WORDS = 100_000
#: At most so many shards are alive at once; then the table is written.
CHAINED = 4
ADDED = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("hit_spans", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("stop", T.LongType())]))),
        T.StructField("hit_items", T.ArrayType(T.StringType())),
    ]
)


def item_words(text: str | None) -> list[bytes]:
    found = words.find_words(pa.array([text or ""], pa.large_string()), words.ALPHANUMERIC, lower=True)
    raw = found.data.tobytes()
    return [raw[a:b] for a, b in zip(found.starts.tolist(), found.ends.tolist(), strict=True)]


class Automaton:
    """A generalised suffix automaton of items given as lists of words."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window = window
        vocabulary = sorted({w for _, own in items for w in own})
        code = {w: i for i, w in enumerate(vocabulary)}
        listed = pa.array(vocabulary, pa.large_binary())
        data, offsets = words.buffers(listed)
        hashed = words.sequence_hashes(data, offsets[:-1], offsets[1:])
        order = np.argsort(hashed)
        self.vocabulary, self.codes = hashed[order], order
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.items: list[set] = [set()]
        self.short: list[list[tuple[int, str | None]]] = [[]]
        pairs = set()
        self.least = window
        ends: list[tuple[list[int], str | None]] = []
        for name, own in items:
            tokens = [code[w] for w in own]
            pairs.update(zip(tokens, tokens[1:]))  # noqa: B905
            state = 0
            for token in tokens:
                state = self._extend(state, token)
            if tokens:
                ends.append((tokens, name))
                self.least = min(self.least, len(tokens))
        for tokens, name in ends:
            self._list_item(tokens, name)
        self.pairs = np.array(sorted(a * len(vocabulary) + b for a, b in pairs), dtype=np.int64)
        self._found: dict[int, tuple[set, list]] = {}

    def _state(self, length: int, like: int | None = None) -> int:
        self.next.append({} if like is None else dict(self.next[like]))
        self.link.append(-1 if like is None else self.link[like])
        self.length.append(length)
        self.items.append(set())
        self.short.append([])
        return len(self.next) - 1

    def _split(self, state: int, token: int, target: int) -> int:
        """The state for the run of ``state`` and ``token`` alone, parted from longer ones."""
        if self.length[target] == self.length[state] + 1:
            return target
        alone = self._state(self.length[state] + 1, like=target)
        self.link[target] = alone
        while state >= 0 and self.next[state].get(token) == target:
            self.next[state][token] = alone
            state = self.link[state]
        return alone

    def _extend(self, last: int, token: int) -> int:
        known = self.next[last].get(token)
        if known is not None:
            return self._split(last, token, known)
        new = self._state(self.length[last] + 1)
        state = last
        while state >= 0 and token not in self.next[state]:
            self.next[state][token] = new
            state = self.link[state]
        self.link[new] = 0 if state < 0 else self._split(state, token, self.next[state][token])
        return new

    def _list_item(self, tokens: list[int], name: str | None) -> None:
        """Note the item at the states of its windows."""
        state = 0
        for token in tokens:
            state = self.next[state][token]
            up = state
            while up > 0 and self.length[up] >= self.window and name is not None and name not in self.items[up]:
                self.items[up].add(name)
                up = self.link[up]
        if len(tokens) < self.window:
            self.short[state].append((len(tokens), name))

    def _hits(self, state: int) -> tuple[set, list]:
        """Items with the window that ends in this state, and the short items that end in it."""
        found = self._found.get(state)
        if found is None:
            short, up, gate = [], state, state
            while up > 0:
                short += self.short[up]
                if self.length[up] >= self.window:
                    gate = up
                up = self.link[up]
            found = self._found[state] = (self.items[gate] if self.length[gate] >= self.window else set(), short)
        return found

    def scan(self, tokens: list[int]) -> tuple[list[tuple[int, int]], set]:
        """Hit ranges of words, possibly overlapping, and the items with occurring windows."""
        state = length = 0
        spans, found = [], set()
        for i, token in enumerate(tokens):
            while state and token not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if token not in self.next[state]:
                continue
            state, length = self.next[state][token], length + 1
            listed, short = self._hits(state)
            if length >= self.window:
                spans.append((i + 1 - length, i + 1))
                found |= listed
            for size, name in short:
                if size <= length:
                    spans.append((i + 1 - size, i + 1))
                    if name is not None:
                        found.add(name)
        return spans, found

    def stretches(self, found: words.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of all words (-1: in no item), and first and last word of each stretch to scan."""
        n = len(found)
        if not n or not len(self.vocabulary):
            return np.full(n, -1), np.empty(0, np.int64), np.empty(0, np.int64)
        h = found.hashes()
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        codes = np.where(self.vocabulary[at] == h, self.codes[at], -1)
        known = codes >= 0
        joined = known[:-1] & known[1:]
        starts = found.first[1:-1]
        joined[starts[(starts > 0) & (starts < n)] - 1] = False
        where = np.flatnonzero(joined)
        pairs = codes[where] * len(self.vocabulary) + codes[where + 1]
        if len(self.pairs):
            at = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
            joined[where[self.pairs[at] != pairs]] = False
        else:
            joined[:] = False
        begins = np.flatnonzero(known & ~np.concatenate([[False], joined]))
        stops = np.flatnonzero(known & ~np.concatenate([joined, [False]])) + 1
        long = stops - begins >= self.least
        return codes, begins[long], stops[long]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of ranges, as ordered ranges that don't touch."""
    out: list[tuple[int, int]] = []
    for first, stop in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((first, stop))
    return out


def _shards(benchmark: DataFrame, item: str, text: str) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """Distinct items in shards small enough to broadcast."""
    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")).where("text is not null").distinct()
    size = F.length("text") / 6
    total = rows.agg(F.sum(size)).first()[0] or 0
    count = max(1, math.ceil(1.5 * total / SHARD_WORDS))
    numbered = rows.withColumn("shard", F.pmod(F.xxhash64("item", "text"), F.lit(count)))
    for shard in range(count):
        yield [(r["item"], item_words(r["text"])) for r in numbered.where(F.col("shard") == shard).select("item", "text").collect()]


def _kept_automaton(group: str, name: str, items, window: int) -> Automaton:
    """The automaton of a shard, built once in a process; a process keeps those of the group it used last."""
    kept = words.kept_in_process("automaton", dict)
    if group not in kept:
        kept.clear()
        kept[group] = {}
    if name not in kept[group]:
        kept[group][name] = Automaton(items, window)
    return kept[group][name]


def _scanner(items, window: int, text: str, again: bool, group: str):
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _kept_automaton(group, name, items, window)
        for batch in batches:
            for block in words.blocks(batch, text):
                found = words.find_words(words.strings(block, text), words.ALPHANUMERIC, lower=True)
                codes, begins, stops = own.stretches(found)
                text_of = np.searchsorted(found.first, begins, side="right") - 1
                spans: dict[int, list] = {}
                names: dict[int, set] = {}
                for t, begin, stop in zip(text_of.tolist(), begins.tolist(), stops.tolist(), strict=True):
                    hits, listed = own.scan(codes[begin:stop].tolist())
                    if hits:
                        shift = begin - int(found.first[t])
                        spans.setdefault(t, []).extend((a + shift, b + shift) for a, b in hits)
                        names.setdefault(t, set()).update(listed)
                columns, kept = list(block.columns), block.schema.names
                if again:
                    for t, (old_spans, old_names) in enumerate(zip(columns[-2].to_pylist(), columns[-1].to_pylist(), strict=True)):
                        if old_spans:
                            spans.setdefault(t, []).extend((s["first"], s["stop"]) for s in old_spans)
                            names.setdefault(t, set()).update(old_names)
                    columns, kept = columns[:-3], kept[:-3]
                n = block.num_rows
                listed = [[{"first": a, "stop": b} for a, b in merged(spans[t])] if t in spans else [] for t in range(n)]
                added = [
                    pa.array(found.counts(), pa.int64()),
                    pa.array(listed, pa.list_(pa.struct([("first", pa.int64()), ("stop", pa.int64())]))),
                    pa.array([sorted(names.get(t, ())) for t in range(n)], pa.list_(pa.string())),
                ]
                yield pa.RecordBatch.from_arrays([*columns, *added], names=[*kept, *ADDED.names])

    return run


def _in_turn(steps: list):
    """One function of batches that does all steps, in one Python worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps:
            batches = step(batches)
        return batches

    return run


def _scanned(rows: DataFrame, benchmark: DataFrame, window: int, text: str, item: str, item_text: str, last=None) -> DataFrame:
    """The rows with the columns of ``ADDED``; or what ``last`` makes of these, as rows of the input's schema."""
    out, schema = rows, T.StructType([*rows.schema.fields, *ADDED.fields])
    group, steps = uuid.uuid4().hex, []
    for n, items in enumerate(_shards(benchmark, item, item_text)):
        if n and n % CHAINED == 0:
            out = stage(out.mapInArrow(_in_turn(steps), schema), "hits")
            group, steps = uuid.uuid4().hex, []
        steps.append(_scanner(items, window, text, again=n > 0, group=group))
    if last is not None:
        return out.mapInArrow(_in_turn([*steps, last]), rows.schema)
    return out.mapInArrow(_in_turn(steps), schema)


def find_hits(df: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """All columns, ``n_words``, ``hit_spans`` (ranges of words) and ``hit_items`` (sorted ids)."""
    own = Aside(df)
    return own.back(_scanned(own.rows, benchmark, window, own.of(text), item, item_text), *ADDED.names)


def hit_words() -> F.Column:
    """How many words lie in hits."""
    return F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["first"])


def remove_hits(df: DataFrame, benchmark: DataFrame, window: int = 10, coverage: float = 0.5, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The table without benchmark passages.

    A document of whose words more than the share ``coverage`` are hit goes; from the others every
    hit is cut out, from its first word's first byte to its last word's last byte.
    """
    own = Aside(df)
    text, columns = own.of(text), own.numbers

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = batch.column(batch.schema.get_field_index("hit_spans")).to_pylist()
            n_words = batch.column(batch.schema.get_field_index("n_words")).to_pylist()
            stay = [sum(s["stop"] - s["first"] for s in spans) <= coverage * n for spans, n in zip(hits, n_words, strict=True)]
            batch = batch.select(columns).filter(pa.array(stay, pa.bool_()))
            hits = [spans for spans, stays in zip(hits, stay, strict=True) if stays]
            if any(hits):
                at = batch.schema.get_field_index(text)
                texts = batch.column(at).to_pylist()
                for t, spans in enumerate(hits):
                    if spans:
                        found = words.find_words(pa.array([texts[t]], pa.large_string()), words.ALPHANUMERIC, lower=True)
                        raw, end, kept = texts[t].encode(), 0, []
                        for s in spans:
                            kept.append(raw[end : found.starts[s["first"]]])
                            end = int(found.ends[s["stop"] - 1])
                        texts[t] = b"".join([*kept, raw[end:]]).decode()
                batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            yield batch

    return own.back(_scanned(own.rows, benchmark, window, text, item, item_text, last=cut))
