"""How the sources of a language differ in the words they use, measured on exact integers.

Terms are runs of letters (every character beyond ASCII is one), A-Z lower-cased.  A language keeps the
terms of at least ``MIN_DOCUMENTS`` of its documents.  A group, one source of a language, gives a kept term
the share ``p = 1 + floor(10**9 * (count + 1) / (N + V))``: N occurrences of kept terms in the group, V kept
terms.  Two shares differ by ``floor((p - q)**2 / q)``.

* ``pair``: for every other source of the language, the sum of that over all kept terms.
* ``term``: terms of the group whose share is above the language's, the most different ``TOP`` of them.

Row accumulation after Gustavson: the index is term-major, a row holding the counts of all groups with the
term.  A group walks through its terms and scatters, for every peer found there, into one dense accumulator
with a place per peer, so pairs of postings are never rows.  What is scattered corrects a baseline in which
both groups lack all terms but their own::

    sum(g, h) = V f(p0g, p0h) + sum over g's terms [f(p, p0h) - f(p0g, p0h)]
              + sum over h's terms [f(p0g, q) - f(p0g, p0h)]
              + sum over common terms [f(p, q) - f(p, p0h) - f(p0g, q) + f(p0g, p0h)]

with p0 the share of a term that a group lacks.  The two sums in the middle need only how many terms have which
count.  The index is spread by term, so a frequent term is one row with at most one posting a group, and a
source with a third of the documents is pre-aggregated before it is shuffled.

Groups are listed on the driver and known to every task.  The result has a row for each two of them, so their
number is small; ``MAX_GROUPS`` is checked.

Null text, language and source count as empty.  Repeated rows count as often as they occur.  Groups without
kept terms take part in pairs (a language that keeps none has sums of 0).  Other columns are not read, so their
names don't matter; an empty table gives an empty result.  A text is one piece in memory, however long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headroom.llm import termcounts, words
from headroom.sources.staging import stage

MIN_DOCUMENTS = 3
TOP = 200
MAX_GROUPS = 100_000
#: Postings that one task scatters at a time, and cells of a dense block of baselines.
POSTINGS = 1 << 18
CELLS = 1 << 20
UNIT_DIGITS = 3  # times 1000 each: shares are in units of 10**-9


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in words.blocks(batch):
            terms, text, term, n, _ = termcounts.term_counts(words.strings(block, "text"), termcounts.LETTERS)
            langs, sources = (block.column(block.schema.get_field_index(c)).dictionary_encode() for c in ("lang", "source"))
            n_sources = max(len(sources.dictionary), 1)
            group = (langs.indices.to_numpy().astype(np.int64) * n_sources + sources.indices.to_numpy())[text]
            size = max(len(terms), 1)
            found, place = np.unique(group * size + term, return_inverse=True)
            total = np.zeros(len(found), dtype=np.int64)
            np.add.at(total, place, n)
            group, term = found // size, found % size
            yield pa.RecordBatch.from_arrays(
                [langs.dictionary.take(pa.array(group // n_sources)), sources.dictionary.take(pa.array(group % n_sources)), terms.take(pa.array(term)).cast(pa.string()), pa.array(total), pa.array(np.bincount(place, minlength=len(found)).astype(np.int64))],
                ["lang", "source", "term", "n", "d"],
            )


def term_index(docs: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """``lang``, ``term``, ``total`` and ``postings`` (source, n) of the kept terms, written."""
    counts = docs.mapInArrow(_counted, "lang string, source string, term string, n long, d long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    index = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("d").alias("d"), F.collect_list(F.struct("source", "n")).alias("postings"))
    return stage(index.where(F.col("d") >= min_documents).select("lang", "term", "total", "postings"), "terms")


def share(count: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``1 + floor(10**9 * (count + 1) / size)`` by long division, exact for sizes below 9 * 10**15."""
    size = np.maximum(size, 1)
    whole, rest = np.divmod(count + 1, size)
    for _ in range(UNIT_DIGITS):
        digit, rest = np.divmod(rest * 1000, size)
        whole = whole * 1000 + digit
    return 1 + whole


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


class Groups:
    """All groups in the order of language and source, so that the peers of a group are neighbours."""

    def __init__(self, rows: list[tuple[str, str, int, int]]):
        rows = sorted(rows)
        self.langs = sorted({r[0] for r in rows})
        self.sources = sorted({r[1] for r in rows})
        code = {s: i for i, s in enumerate(self.sources)}
        lang = {s: i for i, s in enumerate(self.langs)}
        self.keys = np.array([lang[r[0]] * len(code) + code[r[1]] for r in rows], dtype=np.int64)
        self.order = np.argsort(self.keys)
        self.size = np.array([r[2] + r[3] for r in rows], dtype=np.int64)
        self.none = share(np.zeros(len(rows), dtype=np.int64), self.size)
        owner = np.array([lang[r[0]] for r in rows], dtype=np.int64)
        self.low, self.high = np.searchsorted(owner, owner, "left"), np.searchsorted(owner, owner, "right")

    def find(self, lang: pa.Array, source: pa.Array) -> np.ndarray:
        at = [pc.index_in(a, value_set=pa.array(known, a.type)).to_numpy(zero_copy_only=False).astype(np.int64) for a, known in ((lang, self.langs), (source, self.sources))]
        return self.order[np.searchsorted(self.keys, at[0] * len(self.sources) + at[1], sorter=self.order)]


def _sums(group: int, peers: np.ndarray, value: np.ndarray, flipped: bool = False) -> pa.RecordBatch:
    some = np.flatnonzero(value)
    own = np.full(len(some), group, dtype=np.int64)
    a, b = (peers[some], own) if flipped else (own, peers[some])
    return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), pa.array(value[some])], ["g", "h", "value"])


def _scatter(groups: Groups):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in termcounts.rows_of(batches, lambda b: len(pc.list_flatten(b.column(1))), POSTINGS):
            lists = block.column(1)
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            first = np.concatenate([[0], np.cumsum(sizes)])
            term = np.repeat(np.arange(len(sizes)), sizes)
            flat = lists.flatten()
            who = groups.find(block.column(0).take(pa.array(term)), flat.field("source"))
            p = share(flat.field("n").to_numpy(zero_copy_only=False), groups.size[who])
            order = np.argsort(who, kind="stable")
            begins = np.flatnonzero(np.diff(who[order], prepend=-1))
            for begin, end in zip(begins, np.append(begins[1:], len(order))):
                own = order[begin:end]
                g = who[own[0]]
                met = sizes[term[own]]
                other = np.arange(met.sum()) - np.repeat(np.cumsum(met) - met - first[term[own]], met)
                mine, h, q = np.repeat(p[own], met), who[other], p[other]
                zero = groups.none[h]
                change = gap(mine, q) - gap(mine, zero) - gap(groups.none[g], q) + gap(groups.none[g], zero)
                low, high = groups.low[g], groups.high[g]
                peers = np.zeros(high - low, dtype=np.int64)
                np.add.at(peers, h - low, change)
                yield _sums(g, np.arange(low, high), peers)

    return run


def _baseline(groups: Groups):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            who = groups.find(batch.column(0), batch.column(1))
            n, terms = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            for g in np.unique(who):
                peers = np.arange(groups.low[g], groups.high[g])
                zero, own = groups.none[peers], groups.none[g]
                rows = np.flatnonzero(who == g)
                forth, back = np.zeros(len(peers), dtype=np.int64), np.zeros(len(peers), dtype=np.int64)
                for part in np.array_split(rows, 1 + len(rows) * len(peers) // CELLS):
                    p = share(n[part], groups.size[who[part]])[:, None]
                    forth += (terms[part][:, None] * (gap(p, zero) - gap(own, zero))).sum(0)
                    back += (terms[part][:, None] * (gap(zero, p) - gap(zero, own))).sum(0)
                yield _sums(g, peers, forth)
                yield _sums(g, peers, back, flipped=True)

    return run


def _share(count: str, size: str) -> F.Column:
    return F.expr(f"1 + (cast({count} + 1 as decimal(19, 0)) * cast(1000000000 as decimal(10, 0))) div ({size})")


def audit(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, top: int = TOP) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value`` and ``rank`` of all groups (see the module)."""
    spark = docs.sparkSession
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), F.col("text"))
    index = term_index(docs, min_documents)
    posted = index.select("lang", F.inline("postings"))
    kept = index.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("total").alias("lang_n"))
    found = docs.select("lang", "source").distinct().join(posted.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left").join(kept, "lang", "left").select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "terms", "lang_n"))).limit(MAX_GROUPS + 1).collect()
    if len(found) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} groups of language and source")
    rows = sorted(tuple(r) for r in found)
    groups = Groups([r[:4] for r in rows])
    listed = spark.createDataFrame([(i, *r, int(groups.none[i])) for i, r in enumerate(rows)], "g long, lang string, source string, n long, terms long, lang_n long, none long")

    pairs = "g long, h long, value long"
    common = index.select("lang", "postings").mapInArrow(_scatter(groups), pairs)
    lone = posted.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("terms")).mapInArrow(_baseline(groups), pairs)
    sums = common.unionAll(lone).groupBy("g", "h").agg(F.sum("value").alias("more"))
    peers = F.broadcast(listed.select(F.col("g").alias("h"), "lang", F.col("source").alias("item"), F.col("none").alias("peer_none")))
    both = listed.select("g", "lang", "source", "terms", "none").repartition("g").join(peers, "lang").where("g <> h")
    pair = both.join(sums, ["g", "h"], "left").select(
        "lang", "source", F.lit("pair").alias("part"), "item",
        F.expr("if(terms = 0, 0L, terms * (((none - peer_none) * (none - peer_none)) div peer_none) + coalesce(more, 0L))").alias("value"),
    )

    known = F.broadcast(listed.select("lang", "source", (F.col("n") + F.col("terms")).alias("size"), (F.col("lang_n") + F.col("terms")).alias("lang_size")))
    marked = index.select("lang", F.col("term").alias("item"), "total", F.inline("postings")).join(known, ["lang", "source"])
    marked = marked.select("lang", "source", F.lit("term").alias("part"), "item", _share("n", "size").alias("p"), _share("total", "lang_size").alias("q")).where("p > q")
    term = marked.select("lang", "source", "part", "item", F.expr("((p - q) * (p - q)) div q").alias("value"))

    def ranked(df: DataFrame) -> DataFrame:
        return df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))

    return ranked(pair).unionAll(ranked(term).where(F.col("rank") <= top))
