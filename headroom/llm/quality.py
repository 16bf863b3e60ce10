r"""Quality rules: statistics of texts, and a decision list learned from labelled ones.

The statistics are Spark expressions over one row.  Learning is sequential covering: a rule starts
empty and grows by the threshold condition with the largest information gain on the grow part of the
labelled rows, is cut back to the prefix that does best on the prune part, and joins the list if it is
precise enough there; then the rows it covers are set aside and the next rule grows.  All counts come
from Spark aggregations over a table of binned statistics; the driver sees counts by condition
only.  The list becomes one ordered conditional expression.

Learning uses at most about ``SAMPLE_ROWS`` labelled rows; statistics and verdicts cover every row.

Null texts have no words, so they fail the base rules like other texts of under 20 words.  With no
labels, or labels of one kind, the list is empty and only the base rules decide.  Rows are judged one by one,
so repeated rows have equal verdicts and an empty table has none.  Input columns named like an added one give way to it
in ``judge``; ``keep`` leaves all of them as they are.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headroom.llm.aside import Aside
from headroom.llm.chat import let
from headroom.llm.sampling import labelled_sample
from headroom.sources.staging import stage

SAMPLE_ROWS = 20_000
REPEAT_WINDOW = 8
LEAST_WORDS, MOST_REPEATED = 20, 30
MAX_RULES, MAX_CONDITIONS = 8, 3
LEAST_PRECISION, LEAST_COVER = 0.9, 5
CUTS = [i / 20 for i in range(1, 20)]
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["n_words", "mean_word_chars", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "mark_share"]


def _repeated_words(words: Column, count: Column) -> Column:
    """Words inside windows found twice or more, in time n log n."""

    def positions(ordered: Column) -> Column:
        same = F.transform(
            ordered,
            lambda e, i: F.struct(
                e["at"].alias("at"),
                (F.coalesce(F.get(ordered, i - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(ordered, i + 1)["h"] == e["h"], F.lit(False))).alias("twice"),
            ),
        )
        return F.sort_array(F.transform(F.filter(same, lambda e: e["twice"]), lambda e: e["at"]))

    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda p, i: F.least(F.lit(REPEAT_WINDOW), F.coalesce(F.get(at, i + 1) - p, F.lit(REPEAT_WINDOW))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda total, gap: total + gap)

    def repeated(windows: Column) -> Column:
        ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(let(let(ordered, positions), covered))

    def windows(hashed: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(hashed) - REPEAT_WINDOW + 1), lambda i: F.xxhash64(F.slice(hashed, i, REPEAT_WINDOW)))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(count > REPEAT_WINDOW, let(let(hashed, windows), repeated)).otherwise(F.lit(0).cast("long"))


def statistics(text: Column) -> Column:
    """A struct of the base counts and of ``upper`` and ``marks`` (capitals; ``!`` and ``?``)."""

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            _repeated_words(words, F.size(words)).alias("n_repeat_words"),
        )

    def of_lines(lines: Column) -> Column:
        return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")

    text = F.coalesce(text, F.lit(""))
    counted = let(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+", -1), ""), of_words)
    lines = let(F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]")), of_lines)
    return F.struct(
        counted.alias("words"),
        lines.alias("n_dup_lines"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit("[A-Z]")).cast("long").alias("upper"),
        F.regexp_count(text, F.lit("[!?]")).cast("long").alias("marks"),
        F.size(F.split(text, "\n", -1)).cast("long").alias("lines"),
    )


def with_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """All columns, the base counts, ``base_failed``, and ``features``, a struct of shares."""
    own = Aside(df)
    rows = own.rows.withColumn("stats", statistics(F.col(own.of(text))))
    s = F.col("stats")
    words = F.greatest(s["words"]["n_words"], F.lit(1))
    chars = F.greatest(s["words"]["word_chars"], F.lit(1))
    features = F.struct(
        s["words"]["n_words"].cast("double").alias("n_words"),
        (s["words"]["word_chars"] / words).alias("mean_word_chars"),
        (s["n_symbols"] / words).alias("symbol_share"),
        (s["n_dup_lines"] / F.greatest(s["lines"], F.lit(1))).alias("dup_line_share"),
        (s["words"]["n_repeat_words"] / words).alias("repeat_share"),
        (s["upper"] / chars).alias("upper_share"),
        (s["marks"] / words).alias("mark_share"),
    )
    counts = {c: s["words"][c] if c in ("n_words", "word_chars", "n_repeat_words") else s[c] for c in BASE}
    failed = (counts["n_words"] < LEAST_WORDS) | (100 * counts["n_repeat_words"] > MOST_REPEATED * counts["n_words"])
    out = rows.select(*own.numbers, *(c.alias(name) for name, c in counts.items()), failed.alias("base_failed"), features.alias("features"))
    return own.back(out, *BASE, "base_failed", "features")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def expression(self) -> Column:
        value = F.col("features")[self.feature]
        return value >= self.threshold if self.above else value < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:g}"


def _all(conditions: list[Condition]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c.expression()
    return out


def rejected(rules: list[list[Condition]]) -> Column:
    """The list as one ordered conditional expression."""
    out = None
    for rule in rules:
        out = F.when(_all(rule), True) if out is None else out.when(_all(rule), True)
    return F.lit(False) if out is None else out.otherwise(False)


def _thresholds(rows: DataFrame) -> dict[str, list[float]]:
    """Quantiles of each statistic, of the bad rows and of the good ones."""
    wanted = [F.percentile_approx(F.when(F.col("bad") == bad, F.col("features")[f]), CUTS, 2000).alias(f"{f}_{bad}") for f in FEATURES for bad in (0, 1)]
    found = rows.agg(*wanted).first()
    return {f: sorted({v for bad in (0, 1) for v in (found[f"{f}_{bad}"] or [])}) for f in FEATURES}


def _grown(rows: DataFrame, thresholds: dict[str, list[float]]) -> list[Condition]:
    """The conjunction grown on the grow part of rows that no rule covers yet."""
    rule: list[Condition] = []
    grow = rows.where("not prune")
    bins = F.array(*(F.struct(F.lit(f).alias("feature"), F.expr(f"size(filter(array({', '.join(f'{t!r}D' for t in thresholds[f]) or 'cast(null as double)'}), t -> t <= features.{f}))").alias("bin")) for f in FEATURES))
    while len(rule) < MAX_CONDITIONS:
        counted = grow.where(_all(rule)).select(F.explode(bins).alias("b"), "bad").groupBy("b.feature", "b.bin").agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")).collect()
        p0 = sum(r["p"] for r in counted if r["feature"] == FEATURES[0])
        n0 = sum(r["n"] for r in counted if r["feature"] == FEATURES[0])
        if not p0 or not n0:
            break
        best, best_gain = None, 0.0
        for f in FEATURES:
            by_bin = {r["bin"]: (r["p"], r["n"]) for r in counted if r["feature"] == f}
            for k, threshold in enumerate(thresholds[f]):
                p = sum(v[0] for b, v in by_bin.items() if b > k)
                n = sum(v[1] for b, v in by_bin.items() if b > k)
                for above, p1, n1 in ((True, p, n), (False, p0 - p, n0 - n)):
                    if p1:
                        gain = p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p0 / (p0 + n0)))
                        if gain > best_gain + 1e-9:
                            best, best_gain = Condition(f, above, threshold), gain
        if best is None:
            break
        rule.append(best)
    return rule


def _pruned(rows: DataFrame, rule: list[Condition]) -> tuple[list[Condition], int, int]:
    """The prefix that does best on the prune part, and its counts of bad and good rows there."""
    sums = []
    for k in range(1, len(rule) + 1):
        sums += [F.sum(F.when(_all(rule[:k]), bad)).alias(f"{name}{k}") for name, bad in (("p", F.col("bad")), ("n", 1 - F.col("bad")))]
    found = rows.where("prune").agg(*sums).first()
    counts = [(found[f"p{k}"] or 0, found[f"n{k}"] or 0) for k in range(1, len(rule) + 1)]
    k = max(range(len(rule)), key=lambda i: ((counts[i][0] - counts[i][1]) / (sum(counts[i]) or 1), counts[i][0], -i))
    return rule[: k + 1], *counts[k]


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = SAMPLE_ROWS) -> list[list[Condition]]:
    """A decision list for rejecting; label 0 is bad."""
    sample = with_statistics(labelled_sample(docs, labels, label, rows, key, text), "_text")
    sample = sample.where("not base_failed").select("features", (F.col("y") == 0).cast("int").alias("bad"), (F.pmod(F.col("_order"), F.lit(3)) == 0).alias("prune"))
    sample = stage(sample, "quality")
    thresholds = _thresholds(sample)
    rules: list[list[Condition]] = []
    while len(rules) < MAX_RULES:
        left = sample.where(~rejected(rules))
        rule = _grown(left, thresholds)
        if not rule:
            break
        rule, p, n = _pruned(left, rule)
        if p < LEAST_COVER or p < LEAST_PRECISION * (p + n):
            break
        rules.append(rule)
    return rules


def judge(df: DataFrame, rules: list[list[Condition]], text: str = "text") -> DataFrame:
    """All columns, the statistics, ``base_failed`` and ``kept``."""
    own = Aside(df)
    judged = with_statistics(own.rows, own.of(text)).withColumn("kept", ~F.col("base_failed") & ~rejected(rules))
    return own.back(judged, *BASE, "base_failed", "kept")


def keep(df: DataFrame, rules: list[list[Condition]], text: str = "text") -> DataFrame:
    """The rows that are kept, with the table's own columns and no others."""
    own = Aside(df)
    return own.back(judge(own.rows, rules, own.of(text)).where("kept"))
