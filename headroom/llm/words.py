"""Words of Arrow string columns, found and hashed on whole blocks of bytes.

Separators are ASCII, so a word is a run of bytes and UTF-8 never has to be decoded.  A block
holds whole texts of about ``BLOCK_BYTES`` together (one longer text is a block of its own), which
bounds memory by the longest text and not by the size of a batch or partition.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 21
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_WRAP = (1 << 64) - 1


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 flags, true for bytes inside one of the closed ranges."""
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


NOT_BLANK = ~byte_set((0x20, 0x20), (0x09, 0x0D))
ALPHANUMERIC = byte_set((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def small_batches(spark) -> None:
    """Let Spark hand batches of some MB to Python, however long the rows are."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2000)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20)


def kept_in_process(name: str, make):
    """What ``make`` returns, made once in each worker process."""
    store = sys.modules.setdefault("_headroom_llm_kept", types.ModuleType("_headroom_llm_kept"))
    if not hasattr(store, name):
        setattr(store, name, make())
    return getattr(store, name)


def strings(batch: pa.RecordBatch, column: str) -> pa.LargeStringArray:
    """A string column with 64-bit offsets; nulls become empty texts."""
    return pc.fill_null(batch.column(batch.schema.get_field_index(column)).cast(pa.large_string()), "")


def buffers(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the texts and the offset of each text in them, one more for the end."""
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, at - at[0]


def blocks(batch: pa.RecordBatch, column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have at most ``limit`` bytes together, or one row."""
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (an invertible finaliser)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base`` and its inverse to the powers 0..n-1, modulo 2**64."""
    store = kept_in_process("powers", dict)
    have = store.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, BLOCK_BYTES + 1)
        tables = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b & _WRAP, dtype=np.uint64)
            steps[0] = 1
            tables.append(np.cumprod(steps, dtype=np.uint64))
        have = store[base] = tuple(tables)
    return have


def sequence_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASES[0]) -> np.ndarray:
    """A 64-bit hash of each ``values[start:end]``, the same wherever the run stands."""
    up, down = _powers(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=sums[1:])
    length = (ends - starts).astype(np.uint64)
    return mix((sums[ends] - sums[starts]) * down[starts] + length * np.uint64(base ^ 0x5851F42D4C957F2D))


@dataclass
class Words:
    """Words of the texts of one block; text t has the words ``first[t]`` to ``first[t + 1]``."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, base: int = BASES[0]) -> np.ndarray:
        return sequence_hashes(self.data, self.starts, self.ends, base)

    def windows(self, size: int) -> np.ndarray:
        """Indices of the words at which a run of ``size`` words of one text starts."""
        left = np.repeat(self.first[1:], self.counts()) - np.arange(len(self))
        return np.flatnonzero(left >= size)

    def text_of(self) -> np.ndarray:
        """For each word, the number of its text."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def find_words(texts: pa.LargeStringArray, inside: np.ndarray = NOT_BLANK, lower: bool = False) -> Words:
    """The maximal runs of bytes of the set ``inside``, after lower-casing A-Z if asked for."""
    data, offsets = buffers(texts)
    if lower:
        data = LOWER[data]
    mask = inside[data]
    edge = offsets[:-1][offsets[:-1] < len(data)]
    before = np.empty_like(mask)
    before[1:] = mask[:-1]
    before[:1] = False
    before[edge] = False
    starts = np.flatnonzero(mask & ~before)
    after = np.empty_like(mask)
    after[:-1] = mask[1:]
    after[-1:] = False
    after[edge[edge > 0] - 1] = False
    ends = np.flatnonzero(mask & ~after) + 1
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets))


def window_hashes(words: np.ndarray, starts: np.ndarray, size: int, base: int = BASES[0]) -> np.ndarray:
    """Hashes of the runs of ``size`` word hashes that start at ``starts``."""
    return sequence_hashes(words, starts, starts + size, base)
