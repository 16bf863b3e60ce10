r"""Lines that repeat, exactly or nearly, are kept once.

A line is a ``\n``-separated part of a text with a word in it.  Lines are alike if the sets of
their runs of ``SHINGLE`` characters have a Jaccard similarity of ``threshold`` or more; a line shorter
than that is alike to its copies only.  Of each class of lines, the one in the smallest document, at
its first place, stays.

* Candidates: the hashes of all distinct runs of a line fall into ``BINS`` bins.  The least of each bin
  is a MinHash value; an empty bin takes the one of the next bin that isn't, which keeps the probability
  of equal values at the Jaccard similarity.  The values of a few bins make a band key: of more bins
  the more runs a line has, since long lines meet by chance more often and short ones have few values.
* Copies of a line collapse by a 128-bit hash before anything else, so a frequent line is one row.
* Pairs are verified on all runs of both lines; classes come from ``linking.link``.

Signing and verifying read every character, and as expressions they took over 1,600 CPU seconds a GB; they run on
Arrow blocks of whole lines instead.  All else is expressions, aggregations and joins.  Blank lines are never removed.  Null texts stay
null, empty ones empty, and texts keep their other line breaks.  Identical rows (same key and text)
share their fate; rows with a null key count as the largest.  A column named like ``removed`` gives way to it, all
others stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headroom.llm import linking, words
from headroom.llm.aside import Aside
from headroom.llm.chat import let
from headroom.sources.staging import stage

SHINGLE = 5
THRESHOLD = 0.8
BIN_BITS = 6
BINS = 1 << BIN_BITS
#: Least and most distinct runs of a line, number of bands, and the bins of the first band.  Lines of similarity
#: ``THRESHOLD`` have a tier in common: each begins at that share of the first size beyond the one before.
TIERS = (
    (1, 24, 10, (0, 11)),
    (20, 96, 12, (0, 11, 27)),
    (77, None, 14, (0, 11, 27, 38, 51)),
)
_LAST = 2**63 - 1
#: Words of 64 bits of the sketches of lines that meet all others of a bucket; lines of 500 runs that are
#: 0.79 alike or less are told apart by that, 0.75 by the usual ones.
FINER_WORDS = 32


def _runs(lines: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """Line number and hash of every run of characters, in the order of the text."""
    data, at = words.buffers(lines)
    # where characters begin, and one place more for the end of all
    begins = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    first = np.searchsorted(begins, at)
    sizes = np.maximum(np.diff(first) - SHINGLE + 1, 0)
    line = np.repeat(np.arange(len(lines)), sizes)
    place = np.arange(len(line)) + np.repeat(first[:-1] - (np.cumsum(sizes) - sizes), sizes)
    return line, words.sequence_hashes(data, begins[place], begins[place + SHINGLE])


def band_keys(lines: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """Line number and key of all bands; none of a line that is shorter than a run."""
    line, runs = _runs(lines)
    bits = 64 - max(len(lines) - 1, 1).bit_length()
    # one sort brings a line's runs together, its bins in order, and the least run of each bin first
    keyed = np.sort((line.astype(np.uint64) << np.uint64(bits)) | (runs >> np.uint64(64 - bits)))
    keyed = keyed[np.diff(keyed, prepend=keyed[:1] ^ np.uint64(1)) != 0]
    owner = (keyed >> np.uint64(bits)).astype(np.int64)
    n = np.bincount(owner, minlength=len(lines))
    bin_ = ((keyed >> np.uint64(bits - BIN_BITS)) & np.uint64(BINS - 1)).astype(np.int64)
    place = owner * BINS + bin_
    least = np.flatnonzero(np.diff(place, prepend=-1))
    signed = np.flatnonzero(n)
    row = np.zeros(len(lines), dtype=np.int64)
    row[signed] = np.arange(len(signed))
    # each bin's least run, or that of the next bin that has one, around the end
    has = np.full((len(signed), 2 * BINS), 2 * BINS)
    has[row[owner[least]], bin_[least]] = bin_[least]
    has[row[owner[least]], bin_[least] + BINS] = bin_[least] + BINS
    source = np.minimum.accumulate(has[:, ::-1], axis=1)[:, ::-1][:, :BINS] % BINS
    values = np.zeros((len(signed), BINS), dtype=np.uint64)
    # the kept bits of the run's hash, without the line's number
    values[row[owner[least]], bin_[least]] = keyed[least] << np.uint64(64 - bits) >> np.uint64(64 - KEPT_BITS)
    values = np.take_along_axis(values, source, axis=1)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for low, high, count, bins in TIERS:
        own = np.flatnonzero((n[signed] >= low) & (n[signed] <= (high or len(keyed))))
        for i in range(count):
            key = np.full(len(own), len(bins), dtype=np.uint64)
            for b in bins:
                key = words.mix(key * np.uint64(words.BASES[1]) + values[own, (i * BINS // count + b) % BINS])
            found.append((signed[own], key))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]).view(np.int64)


#: Bits of a run's hash that are compared; blocks have fewer than 2**24 lines.
KEPT_BITS = 40


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in words.blocks(batch, "line"):
            line, key = band_keys(words.strings(block, "line"))
            order = np.argsort(line, kind="stable")
            ends = np.concatenate([[0], np.cumsum(np.bincount(line, minlength=block.num_rows))])
            keys = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(key[order]))
            kept = [block.column(block.schema.get_field_index(c)) for c in ("h1", "h2", "place")]
            yield pa.RecordBatch.from_arrays([*kept, keys], ["h1", "h2", "place", "keys"])


def jaccard(a: pa.LargeStringArray, b: pa.LargeStringArray) -> np.ndarray:
    """Similarity of the whole sets of character runs of two lines, for each pair.

    Runs are told apart by their hash next to the pair's number in 64 bits: 48 bits in blocks of 65,536 pairs.
    """
    bits = 64 - max(len(a) - 1, 1).bit_length()

    def distinct(lines: pa.LargeStringArray) -> np.ndarray:
        pair, runs = _runs(lines)
        keys = np.sort((pair.astype(np.uint64) << np.uint64(bits)) | (runs >> np.uint64(64 - bits)))
        return keys[np.diff(keys, prepend=keys[:1] ^ np.uint64(1)) != 0]

    both = np.sort(np.concatenate([distinct(a), distinct(b)]))
    pair = (both >> np.uint64(bits)).astype(np.int64)
    common = np.bincount(pair[1:][both[1:] == both[:-1]], minlength=len(a))
    return common / np.maximum(np.bincount(pair, minlength=len(a)) - common, 1)


def run_sets(lines: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Line number, hash and weight 1 of the distinct runs; of hashes only the first bits, 40 in blocks of fewer than 2**24 lines."""
    line, runs = _runs(lines)
    bits = 64 - max(len(lines) - 1, 1).bit_length()
    keyed = np.sort((line.astype(np.uint64) << np.uint64(bits)) | (runs >> np.uint64(64 - bits)))
    keyed = keyed[np.diff(keyed, prepend=keyed[:1] ^ np.uint64(1)) != 0]
    return (keyed >> np.uint64(bits)).astype(np.int64), keyed << np.uint64(64 - bits), np.ones(len(keyed))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in words.blocks(batch, "line_a"):
            sim = jaccard(words.strings(block, "line_a"), words.strings(block, "line_b"))
            yield pa.RecordBatch.from_arrays([*(block.column(block.schema.get_field_index(c)) for c in "ab"), pa.array(sim)], ["a", "b", "sim"])


def _lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """``doc``, ``mark``, ``pos`` and ``line`` of all lines with a word."""
    texts = df.select(F.coalesce(F.col(key).cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64(text).alias("mark"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    return texts.where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))


def _place() -> Column:
    """Document and position as one number that orders like them."""
    return F.col("doc").cast("decimal(20,0)") * F.lit(2**32).cast("decimal(10,0)") + F.col("pos")


def _named(lines: DataFrame) -> DataFrame:
    return lines.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit("second"), "line")})


def repeated_lines(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``doc``, ``mark`` and ``gone``, the positions of lines to remove."""
    lines = _named(_lines(df, key, text))
    words.small_batches(df.sparkSession)
    keyed = lines.select("h1", "h2", _place().alias("place"), "line")
    keyed = keyed.mapInArrow(_sign, f"h1 long, h2 long, place {keyed.schema['place'].dataType.simpleString()}, keys array<long>")
    distinct = keyed.groupBy("h1", "h2").agg(F.min("place").alias("place"), F.count("*").alias("copies"), F.first("keys").alias("keys"))
    distinct = stage(distinct, "lines")
    members = distinct.select(F.explode("keys").alias("key"), F.col("h1").alias("node"))

    texts = None

    def prepare(nodes: DataFrame) -> None:
        nonlocal texts
        found = linking.among(lines.select(F.col("h1").alias("node"), "line"), "node", nodes, "node")
        texts = stage(found.groupBy("node").agg(F.min("line").alias("line")), "texts")

    def compare(pairs: DataFrame) -> DataFrame:
        return linking.with_texts(pairs, texts, "line").mapInArrow(_verify, "a long, b long, sim double")

    def sketch(nodes: DataFrame) -> DataFrame:
        return linking.sketches(texts, "line", run_sets)

    def finer(nodes: DataFrame) -> DataFrame:
        return linking.sketches(linking.among(texts, "node", nodes, "node"), "line", run_sets, FINER_WORDS)

    roots = linking.link(members, compare, threshold, prepare, sketch=sketch, finer=finer)
    several = distinct.where("copies > 1").select("h1", "h2", F.col("place").alias("first"))
    if roots is not None:
        alike = distinct.join(roots, distinct["h1"] == roots["node"])
        first = alike.groupBy("root").agg(F.min("place").alias("first"))
        alike = alike.join(first, "root").select("h1", "h2", "first")
        several = several.join(alike, ["h1", "h2"], "left_anti").unionAll(alike)
    several = stage(several, "several")
    places = linking.among(lines.select("h1", "h2", "doc", "mark", "pos"), "h1", several, "h1")
    gone = places.join(several, ["h1", "h2"]).where(_place() != F.col("first"))
    return gone.groupBy("doc", "mark").agg(F.collect_set("pos").alias("gone"))


def dedup_lines(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, removed: str | None = None) -> DataFrame:
    """All columns, ``text`` without repeated lines; ``removed`` names a column for their number."""
    own = Aside(df)
    key, text = own.of(key), own.of(text)
    gone = stage(repeated_lines(own.rows, key, text, threshold), "gone")
    rows = own.rows.withColumns({"doc": F.coalesce(F.col(key).cast("long"), F.lit(_LAST)), "mark": F.xxhash64(text)})
    # texts that lose nothing need not travel
    rows = linking.marked(rows, "mark", gone, "mark", "loses")
    whole = rows.where("not loses").withColumn("gone", F.lit(None).cast("array<int>"))
    rows = rows.where("loses").join(gone, ["doc", "mark"], "left").unionByName(whole)

    def kept_lines(lines: Column) -> Column:
        at = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
        return F.transform(at, lambda i: F.get(lines, i))

    kept = F.array_join(let(F.split(F.col(text), "\n", -1), kept_lines), "\n")
    kept = F.when(F.col("gone").isNull(), F.col(text)).otherwise(kept)
    columns = [kept.alias(text) if c == text else F.col(c) for c in own.numbers]
    if removed:
        columns.append(F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias(removed))
    return own.back(rows.select(columns), *([removed] if removed else []))
