"""Ranked lexical search by pipelined term partitioning.

Terms are runs of letters and digits (every character beyond ASCII is a letter), A-Z lower-cased.  A term's
weight is ``w = floor(1000 ln((2 N + 2) / (2 df + 1)))``; a document that holds it tf times gains
``w * ((10**9 tf) div (1000 tf + 12 m))`` for each time the term stands in the item, with
``m = 75 + (25 n N) div L`` for a document of n terms (N documents with terms, L terms in all).

The terms have ``len(SHARES) + 1`` owners, by the share of documents that hold them: rare terms first.  An item
is a bundle that visits one owner after the other, each a ``cogroup`` of bundles with the postings that the
owner holds.  A bundle carries the item's terms and a sparse accumulator, documents with integer scores, to
which an owner adds its contributions.  What can't be selected any more is dropped on the way, exactly: a
contribution is below ``10**6 w``, so a document stays only if it could still reach the score that the
``top``-th document of its slice has already.  After the last owner each slice hands on its ``top`` documents of
an item, of which a window takes the best.

No task holds a whole index or accumulator: documents are cut into slices of at most ``2**SLICE_BITS`` and items
into blocks of about ``BLOCK``, and a bundle is one item's part for one slice.  Texts are read once, and only
postings of terms of some item are kept.  An owner's terms are broadcast to the postings up to ``LOOKUP`` rows and
joined by a salted shuffle beyond, so a word of every document is never one task's.

Null texts and texts without terms match nothing; a repeated document is ranked as often as it occurs, a
repeated item gets its ranks once for each row.  Documents of equal score and id follow in the order in which
they were read; a null id comes last, with the largest id there is.  An empty table of either kind gives an empty result.  Other columns
aren't read.  Document ids are integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from headroom.llm import linking, termcounts, words
from headroom.sources.staging import stage

TOP = 20
#: Upper ends, as shares of the documents, of what the owners before the last one hold.
SHARES = (0.001, 0.02, 0.15)
SLICE_BITS = 13
BLOCK = 256
#: Rows of an owner's terms that are broadcast, and the parts of a shuffle of more.
LOOKUP = 500_000
SALTS = 64
#: No contribution is above this times its weight.
FULL = 1_000_000
LAST = 2**63 - 1


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each term of a text; ``first`` marks one of them, with the text's ``size``."""
    for batch in batches:
        for block in words.blocks(batch):
            terms, text, term, n, total = termcounts.term_counts(words.strings(block, "text"), termcounts.ALPHANUMERIC)
            row, key = (block.column(block.schema.get_field_index(c)).take(pa.array(text)) for c in ("row", "id"))
            first = np.diff(text, prepend=-1) > 0
            yield pa.RecordBatch.from_arrays(
                [row, key, pa.array(total[text].astype(np.int64)), terms.take(pa.array(term)).cast(pa.string()), pa.array(n.astype(np.int64)), pa.array(first)],
                ["row", "id", "size", "term", "tf", "first"],
            )


def _by_term(rows: DataFrame) -> DataFrame:
    return rows.mapInArrow(_postings, "row long, id long, size long, term string, tf long, first boolean")


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The lists of numbers of a column."""
    lists = pc.fill_null(column.combine_chunks(), [])
    return np.split(lists.flatten().to_numpy(), np.cumsum(pc.list_value_length(lists).to_numpy())[:-1]) if len(lists) else []


def _owner(stage_: int, top: int, schema: pa.Schema):
    """One owner's work on the bundles of a slice and a block of items."""

    def visit(bundles: pa.Table, postings: pa.Table) -> pa.Table:
        term, doc, ids, gain = (postings.column(c).to_numpy() for c in ("term", "row", "id", "gain"))
        order = np.argsort(term, kind="stable")
        term, doc, ids, gain = term[order], doc[order], ids[order], gain[order]
        brought, brought_ids, scores = (_lists(bundles.column(c)) for c in ("docs", "ids", "scores"))
        local = np.unique(np.concatenate([doc, *brought]))
        at, name = np.searchsorted(local, doc), np.zeros(len(local), dtype=np.int64)
        name[at] = ids
        kept: dict[str, list] = {"docs": [], "ids": [], "scores": []}
        for i in range(bundles.num_rows):
            terms = bundles.column("terms")[i].as_py()
            score = np.zeros(len(local), dtype=np.int64)
            place = np.searchsorted(local, brought[i])
            score[place], name[place] = scores[i], brought_ids[i]
            for t in terms[stage_]:
                # a term has one posting in a document, so no place repeats
                run = slice(np.searchsorted(term, t["term"], "left"), np.searchsorted(term, t["term"], "right"))
                score[at[run]] += t["w"] * gain[run]
            to_come = FULL * sum(t["w"] for later in terms[stage_ + 1 :] for t in later)
            some = np.flatnonzero(score)
            if len(some) > top:
                least = np.partition(score[some], len(some) - top)[len(some) - top]
                some = some[score[some] + to_come >= least]
            if stage_ + 1 == len(terms):
                some = some[np.lexsort((local[some], name[some], -score[some]))][:top]
            for column, values in zip(kept.values(), (local, name, score)):
                column.append(values[some])
        listed = {c: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *rows]))) for c, rows in kept.items()}
        same = {c: bundles.column(c) for c in ("slice", "block", "item", "terms")}
        return pa.table(same | listed).select(schema.names).cast(schema)

    return visit


def weighted_terms(asked: DataFrame, postings: DataFrame, documents: int, shares: tuple[float, ...]) -> DataFrame:
    """``row`` of an item, ``term``, ``number``, ``w`` (for all repeats) and ``owner`` of its terms that some document holds."""
    held = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    known = asked.select("term").distinct().join(held, "term")
    owner = sum((F.when(F.col("df") > F.lit(s * documents), 1).otherwise(0) for s in shares), F.lit(0))
    weight = F.floor(1000 * F.log((2 * F.lit(documents) + 2) / (2 * F.col("df") + 1))).cast("long")
    # written, so that a number stays a term's
    known = stage(known.select("term", F.monotonically_increasing_id().alias("number"), weight.alias("w"), owner.alias("owner")), "weights")
    return asked.join(known, "term").select("row", "term", "number", (F.col("w") * F.col("tf")).alias("w"), "owner")


def _owned(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings of an owner's terms, once for each block of items that asks for them."""
    lookup = stage(terms.groupBy("term", "number").agg(F.collect_set("block").alias("blocks")), "owned")
    if lookup.count() <= LOOKUP:
        found = postings.join(F.broadcast(lookup), "term")
    else:
        salted = linking.among(postings, "term", lookup, "term").withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)))
        found = salted.join(lookup.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["term", "salt"])
    return found.select(F.shiftright("row", SLICE_BITS).alias("slice"), F.explode("blocks").alias("block"), F.col("number").alias("term"), "row", "id", "gain")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, key: str = "doc_id", item_key: str = "item_id", shares: tuple[float, ...] = SHARES) -> DataFrame:
    """``item_key``, ``rank``, ``key`` and ``score``: for every item the ``top`` documents with a score above 0."""
    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    named = stage(items.select(F.col(item_key).alias("name"), text).withColumn("row", F.monotonically_increasing_id()), "items")
    asked = stage(_by_term(named.select("row", F.col("row").alias("id"), "text")).select("row", "term", "tf"), "item_terms")
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("id"), text).withColumn("row", F.monotonically_increasing_id())
    seen = Observation()
    read = _by_term(rows).observe(seen, F.count_if("first").alias("documents"), F.sum(F.when(F.col("first"), F.col("size"))).alias("terms"))
    postings = stage(linking.among(read, "term", asked, "term").drop("first"), "postings")
    # the plan over an empty table may fold away, and what would be observed with it
    documents, length = (0, 0) if docs.isEmpty() or asked.isEmpty() else (seen.get["documents"], seen.get["terms"] or 0)
    terms = weighted_terms(asked, postings, documents, shares)
    blocks = 1 + named.count() // BLOCK
    terms = stage(terms.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks))), "asked")

    m = F.expr(f"75 + (25 * size * {documents}L) div {max(length, 1)}L")
    gains = postings.withColumn("m", m).select("row", "id", "term", F.expr("(1000000000L * tf) div (1000 * tf + 12 * m)").alias("gain"))
    owned = [_owned(gains, terms.where(F.col("owner") == s)) for s in range(len(shares) + 1)]
    lists = [F.collect_list(F.when(F.col("owner") == s, F.struct(F.col("number").alias("term"), "w"))) for s in range(len(owned))]
    carried = terms.groupBy("block", "row").agg(F.array(*lists).alias("terms"))
    # every slice meets the items of every block; salts keep one block's slices apart
    slices = postings.select(F.shiftright("row", SLICE_BITS).alias("slice")).distinct()
    salts = F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))
    visiting = slices.select("slice", F.pmod(F.xxhash64("slice"), F.lit(SALTS)).alias("salt"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    none = F.array().cast("array<long>")
    bundles = visiting.join(carried.withColumn("salt", F.explode(salts)), ["block", "salt"]).select("slice", "block", F.col("row").alias("item"), "terms", *(none.alias(c) for c in ("docs", "ids", "scores")))
    for s, held in enumerate(owned):
        visit = _owner(s, top, to_arrow_schema(bundles.schema))
        bundles = bundles.groupBy("slice", "block").cogroup(held.groupBy("slice", "block")).applyInArrow(visit, bundles.schema)
    scored = bundles.select("item", F.inline(F.arrays_zip("docs", "ids", "scores")))
    best = Window.partitionBy("item").orderBy(F.desc("scores"), "ids", "docs")
    ranked = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.join(named.select(F.col("row").alias("item"), "name"), "item").select(F.col("name").alias(item_key), "rank", F.col("ids").alias(key), F.col("scores").alias("score"))
