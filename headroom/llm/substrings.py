"""Passages that repeat across documents, by seeds that are extended both ways.

Every run of ``window`` words of a document chooses a seed, the run of ``SEED_WORDS`` of its words
with the least hash (winnowing).  Equal runs choose equal seeds at the same place, so documents that
share a run meet at a seed.  Neighbouring windows mostly choose the same one; a seed's reach is the
stretch of words covered by the windows that chose it.

1. One aggregation by seed finds the seeds that stand in more than one document, and among them
   those whose reaches differ.  It combines on the map side, so a frequent seed is one row a task.
2. Both sets become bit maps of a fixed size.  They keep texts that share nothing out of the next
   shuffle; a false hit costs a row and changes nothing.
3. A seed with one reach everywhere is extended over all of it at once: the reach is one key.  Where
   reaches differ, the seed is extended window by window.  The smallest document of each key is
   found by another aggregation, and joined back to the places in larger documents.
4. Covered windows of a document unite to maximal repeats, whose words are removed.

Keys are hashes of 128 bits of the words compared.  No pairs of documents are formed, and no group
is collected but the ranges of one document.

Null and empty texts have no words.  Documents of the same id don't remove each other's words, and
each row keeps its own ranges; rows with a null id are left whole and remove nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headroom.llm import linking, words
from headroom.sources.staging import stage

WINDOW = 13
SEED_WORDS = 5
#: Bits of each map of shared seeds (8 MB).
MAP_BITS = 26


class Seeds:
    """The seeds of a block of texts: hash, reach (first and last window) and hash of the reach."""

    def __init__(self, texts: pa.LargeStringArray, window: int):
        self.found = words.find_words(texts)
        self.hashed = self.found.hashes()
        self.window = window
        size = min(SEED_WORDS, window)
        span = window - size + 1
        at = self.found.windows(window)
        if not len(at):
            self.seed = self.reach = np.empty(0, np.uint64)
            self.low = self.high = np.empty(0, np.int64)
            return
        runs = np.arange(len(self.hashed) - size + 1)
        grams = words.window_hashes(self.hashed, runs, size)
        chosen = at + np.lib.stride_tricks.sliding_window_view(grams, span)[at].argmin(axis=1)
        begin = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
        end = np.append(begin[1:], len(at)) - 1
        place = chosen[begin]
        self.low, self.high = at[begin], at[end]
        self.seed = grams[place]
        reach = words.sequence_hashes(self.hashed, self.low, self.high + window, words.BASES[1])
        self.reach = words.mix(reach + (place - self.low).astype(np.uint64))

    def text_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.found.first, at, side="right") - 1


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values, pa.int64())


def _seed_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in words.blocks(batch, "text"):
                seeds = Seeds(words.strings(block, "text"), window)
                ids = block.column(0).take(pa.array(seeds.text_of(seeds.low)))
                yield pa.RecordBatch.from_arrays([_long(seeds.seed), _long(seeds.reach), ids], names=["seed", "reach", "id"])

    return run


def _bit(seed: np.ndarray) -> np.ndarray:
    return (seed >> np.uint64(64 - MAP_BITS)).astype(np.int64)


def _bit_map(seeds: DataFrame) -> np.ndarray:
    """A map of the first bits of the seeds, put together from pieces of fixed size."""
    bit = F.shiftrightunsigned("seed", 64 - MAP_BITS) + 1  # these functions count from one
    pieces = seeds.groupBy(F.bitmap_bucket_number(bit).alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
    out = np.zeros(1 << (MAP_BITS - 3), dtype=np.uint8)
    for piece, bits in pieces.toLocalIterator():
        own = np.frombuffer(bits, dtype=np.uint8)
        start = (piece - 1) * len(own)
        out[start : start + len(own)] = own
    return out


def _key_rows(window: int, shared: np.ndarray, differing: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in words.blocks(batch, "text"):
                seeds = Seeds(words.strings(block, "text"), window)
                bit = _bit(seeds.seed)
                on = lambda bits: (bits[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)  # noqa: B023, E731
                by_window = on(differing)
                whole = np.flatnonzero(on(shared) & ~by_window)
                by_window = np.flatnonzero(by_window)
                sizes = seeds.high[by_window] - seeds.low[by_window] + 1
                each = np.repeat(seeds.low[by_window] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
                one = np.concatenate([seeds.seed[whole], words.window_hashes(seeds.hashed, each, window)])
                two = np.concatenate([seeds.reach[whole], words.window_hashes(seeds.hashed, each, window, words.BASES[1])])
                low = np.concatenate([seeds.low[whole], each])
                high = np.concatenate([seeds.high[whole], each])
                text = seeds.text_of(low)
                first = seeds.found.first[text]
                picked = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [_long(one), _long(two), block.column(0).take(picked), block.column(2).take(picked), pa.array(low - first, pa.int32()), pa.array(high - first + window, pa.int32())],
                    names=["one", "two", "id", "mark", "first", "stop"],
                )

    return run


def repeats(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Per row with repeats: ``id``, ``mark`` (a hash of its text) and ``ranges`` of word numbers.

    A range covers words of windows that also start in a document with a smaller key.
    """
    texts = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"), F.hash(text).alias("mark")).where("id is not null")
    seeds = texts.mapInArrow(_seed_rows(window), "seed long, reach long, id long")
    seeds = seeds.groupBy("seed").agg(F.min("id").alias("least"), F.max("id").alias("most"), (F.min("reach") != F.max("reach")).alias("differ"))
    seeds = stage(seeds.where("least < most").select("seed", "differ"), "seeds")
    shared, differing = _bit_map(seeds), _bit_map(seeds.where("differ"))
    places = stage(texts.mapInArrow(_key_rows(window, shared, differing), "one long, two long, id long, mark int, first int, stop int"), "places")
    least = places.groupBy("one", "two").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most")
    least = stage(least.select("one", "two", "least"), "least")
    covered = linking.among(places, "one", least, "one").join(least, ["one", "two"]).where("id > least")
    return covered.groupBy("id", "mark").agg(F.collect_set(F.struct("first", "stop")).alias("ranges"))


def _removed(ranges: pa.Array, found: words.Words) -> np.ndarray:
    """For each word of a block, whether a range covers it."""
    edge = np.zeros(len(found) + 1, dtype=np.int64)
    for t in np.flatnonzero(ranges.is_valid().to_numpy(zero_copy_only=False)).tolist():
        own = ranges[t].values
        shift = int(found.first[t])
        np.add.at(edge, own.field("first").to_numpy() + shift, 1)
        np.add.at(edge, own.field("stop").to_numpy() + shift, -1)
    return np.cumsum(edge[:-1]) > 0


def _kept_texts(found: words.Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kept words with a space after each, and where each text begins."""
    at = np.flatnonzero(keep)
    starts, sizes = found.starts[at], found.ends[at] - found.starts[at]
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])
    out = np.full(int(begin[-1]), 0x20, dtype=np.uint8)
    shift = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(begin[:-1], sizes) + shift] = found.data[np.repeat(starts, sizes) + shift]
    return out, begin[np.searchsorted(at, found.first)]


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Per row: key, ``n_words``, ``n_removed`` and ``kept``, the words left joined by spaces."""
    return _cut(df, key, text, window, "kept string", lambda plain: plain.decode())


def digest_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """As ``remove_repeats``, with the SHA-256 of the kept text in its place."""
    return _cut(df, key, text, window, "kept_sha256 string", lambda plain: hashlib.sha256(plain).hexdigest())


def _cut(df: DataFrame, key: str, text: str, window: int, column: str, value) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in words.blocks(batch, "text"):
                found = words.find_words(words.strings(block, "text"))
                gone = _removed(block.column(2), found)
                out, begin = _kept_texts(found, ~gone)
                plain = out.tobytes()
                made = [value(plain[a : max(a, b - 1)]) for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
                lost = np.concatenate([[0], np.cumsum(gone)])
                yield pa.RecordBatch.from_arrays(
                    [block.column(0), _long(found.counts()), _long(np.diff(lost[found.first])), pa.array(made, pa.string())],
                    names=[key, "n_words", "n_removed", column.split()[0]],
                )

    found = repeats(df, key, text, window)
    texts = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"), F.hash(text).alias("mark"))
    rows = texts.join(found, ["id", "mark"], "left").select("id", "text", "ranges")
    return rows.mapInArrow(run, f"{key} bigint, n_words bigint, n_removed bigint, {column}")
