"""Byte-level BPE: whole pre-tokens by a minimal perfect hash, the others by merging with a heap.

``encode`` and ``decode`` are narrow operators: one pass over the rows, no shuffle.  Each worker
process builds the tables once from the rank file, whose path every executor must be able to
read.  Pre-tokens of a block are reduced to distinct ones; those that are tokens of the
vocabulary are found all at once in the perfect hash, and each of the others is merged once per
block or taken from a bounded cache.

Null texts count as empty and have no tokens.  Rows are independent, so repeated rows and empty tables need no
special care.  An input column named like ``output`` gives way to it.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from headroom.llm import words
from headroom.llm.aside import Aside

#: Merged pre-tokens that a worker process remembers; the cache is emptied when full.
CACHED = 400_000


def load_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file (base64 token, rank on each line), by rank."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens: list[bytes] = [b""] * (1 + max(int(rank) for _, rank in pairs))
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class PerfectHash:
    """A minimal perfect hash of byte strings: n keys, n places, no two keys in one place.

    Keys fall into buckets by one hash; each bucket, the fullest first, gets the first seed that
    sends its keys to places still free.  A bucket of one key names its place instead, stored as a
    negative seed.  A lookup ends by comparing the stored key, so that strings outside the set
    are recognised.
    """

    def __init__(self, keys: list[bytes], per_bucket: int = 2):
        self.keys = pa.array(keys, pa.large_binary())
        h = self.hashes(self.keys)
        n = self.size = len(keys)
        self.buckets = max(1, n // per_bucket)
        self.seeds = np.zeros(self.buckets, dtype=np.int64)
        self.at = np.full(n, -1, dtype=np.int64)
        bucket = (h % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        sizes = np.diff(edges)
        free = np.ones(n, dtype=bool)
        alone = []
        for b in np.argsort(-sizes, kind="stable"):
            own = order[edges[b] : edges[b + 1]]
            if len(own) == 0:
                break
            if len(own) == 1:
                alone.append((b, own[0]))
                continue
            first = 1
            while True:
                tried = np.arange(first, first + 64, dtype=np.uint64)
                places = np.sort(self._places(h[own][None, :], tried[:, None]), axis=1)
                fits = free[places].all(axis=1) & (np.diff(places, axis=1) > 0).all(axis=1)
                if fits.any():
                    seed = first + int(np.argmax(fits))
                    places = self._places(h[own], np.uint64([seed]))
                    break
                first += 64
            self.seeds[b] = seed
            self.at[places] = own
            free[places] = False
        for (b, key), place in zip(alone, np.flatnonzero(free), strict=True):
            self.seeds[b] = -1 - place
            self.at[place] = key

    @staticmethod
    def hashes(keys: pa.LargeBinaryArray) -> np.ndarray:
        data, offsets = words.buffers(keys)
        return words.sequence_hashes(data, offsets[:-1], offsets[1:])

    def _places(self, h: np.ndarray, seed) -> np.ndarray:
        return (words.mix(h + seed * np.uint64(words.BASES[1])) % np.uint64(self.size)).astype(np.int64)

    def lookup(self, keys: pa.LargeBinaryArray) -> np.ndarray:
        """The index of each key, or -1."""
        h = self.hashes(keys)
        seed = self.seeds[(h % np.uint64(self.buckets)).astype(np.int64)]
        place = np.where(seed < 0, -1 - seed, self._places(h, np.maximum(seed, 0).astype(np.uint64)))
        found = self.at[place]
        same = pc.equal(self.keys.take(pa.array(found)), keys)
        return np.where(same.to_numpy(zero_copy_only=False), found, -1)


def pair_table(ranks: dict[bytes, int]) -> dict[int, int]:
    """Rank of the token that two adjacent tokens make, by ``left << 32 | right``."""
    pairs = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                pairs[left << 32 | right] = rank
    return pairs


def merge(piece: bytes, of_byte: list[int], pairs: dict[int, int]) -> list[int]:
    """Token ids of one pre-token: the lowest-ranked pair is joined first, leftmost among equals.

    Parts are a doubly linked list over the bytes.  Candidate joins wait in a heap, rank above
    place in one integer; ``now`` has the rank of the pair that starts at each part, so that
    candidates whose parts have changed meanwhile are passed over.
    """
    ids = [of_byte[byte] for byte in piece]
    n, get = len(ids), pairs.get
    now = [get(a << 32 | b, -1) for a, b in zip(ids, ids[1:])]  # noqa: B905
    now.append(-1)
    heap = [rank << 32 | i for i, rank in enumerate(now) if rank >= 0]
    heapq.heapify(heap)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while heap:
        best = heapq.heappop(heap)
        rank, i = best >> 32, best & 0xFFFFFFFF
        if now[i] != rank:
            continue
        gone = after[i]
        ids[i], now[gone] = rank, -1
        end = after[i] = after[gone]
        joined = -1
        if end < n:
            before[end] = i
            joined = get(rank << 32 | ids[end], -1)
            if joined >= 0:
                heapq.heappush(heap, joined << 32 | i)
        now[i] = joined
        left = before[i]
        if left >= 0:
            joined = now[left] = get(ids[left] << 32 | rank, -1)
            if joined >= 0:
                heapq.heappush(heap, joined << 32 | left)
    out, i = [], 0
    while i < n:
        out.append(ids[i])
        i = after[i]
    return out


#: Bytes that may begin white space: ASCII's own, and first bytes of longer white space.
MAY_BE_BLANK = words.byte_set((0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0xC2, 0xC2), (0xE1, 0xE3))


def cut_at_spaces(texts: pa.LargeStringArray) -> tuple[pa.LargeStringArray, np.ndarray]:
    """Chunks that begin at the start of a text or at a space before something not blank.

    Also returns the number of the first chunk of each text, and one more for the end.
    """
    data, offsets = words.buffers(texts)
    cut = np.zeros(len(data) + 1, dtype=bool)
    if len(data):
        cut[: len(data) - 1] = (data[:-1] == 0x20) & ~MAY_BE_BLANK[data[1:]]
        last = offsets[1:][offsets[1:] > offsets[:-1]] - 1
        cut[last] = False
        cut[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(cut)
    at = np.append(starts, len(data)).astype(np.int64)
    chunks = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data)))
    return chunks, np.searchsorted(starts, offsets)


def _edges(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def _spread(ids: np.ndarray, counts: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ids put one after the other in the order of ``codes``, and the length of each."""
    sizes = counts[codes]
    first = (_edges(counts)[:-1])[codes]
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return ids[np.repeat(first - (ends - sizes), sizes) + np.arange(total)], sizes


class Codec:
    """Encoder and decoder for one rank file and one pre-token pattern."""

    def __init__(self, path: str, pattern: str):
        self.tokens = load_ranks(path)
        self.ranks = {token: rank for rank, token in enumerate(self.tokens) if token}
        self.pattern = regex.compile(pattern)
        whole = list(self.ranks)
        self.hash = PerfectHash(whole)
        self.hash_ids = np.fromiter((self.ranks[t] for t in whole), dtype=np.int64, count=len(whole))
        self.of_byte = [self.ranks[bytes([b])] for b in range(256)]
        self.pairs = pair_table(self.ranks)
        self.cache: dict[bytes, bytes] = {}

    def _distinct_ids(self, pieces: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pre-tokens one after the other, and how many each has."""
        found = self.hash.lookup(pieces)
        counts = np.ones(len(pieces), dtype=np.int64)
        missing = np.flatnonzero(found < 0)
        merged = []
        for piece, at in zip(pieces.take(pa.array(missing)).to_pylist(), missing.tolist(), strict=True):
            ids = self.cache.get(piece)
            if ids is None:
                ids = array("i", merge(piece, self.of_byte, self.pairs)).tobytes()
                if len(self.cache) >= CACHED:
                    self.cache.clear()
                self.cache[piece] = ids
            merged.append(ids)
            counts[at] = len(ids) // 4
        first = np.cumsum(counts) - counts
        ids = np.empty(int(counts.sum()), dtype=np.int32)
        hit = np.flatnonzero(found >= 0)
        ids[first[hit]] = self.hash_ids[found[hit]]
        if merged:
            spread = np.ones(len(ids), dtype=bool)
            spread[first[hit]] = False
            ids[spread] = np.frombuffer(b"".join(merged), dtype=np.int32)
        return ids, counts

    def encode(self, texts: pa.LargeStringArray) -> pa.ListArray:
        """The ids of each text.

        A pre-token never reaches over a space with something else than white space behind it
        except as its first byte.  Cut at such spaces, equal chunks have equal ids wherever they
        stand, so the pattern runs on distinct chunks only.
        """
        chunks, chunks_of_text = cut_at_spaces(texts)
        chunks = chunks.dictionary_encode()
        found = [self.pattern.findall(chunk) for chunk in chunks.dictionary.to_pylist()]
        lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        pieces = pa.array([piece for own in found for piece in own], pa.large_string()).dictionary_encode()
        ids, counts = self._distinct_ids(pieces.dictionary.cast(pa.large_binary()))
        ids, counts = _spread(ids, counts, pieces.indices.to_numpy(zero_copy_only=False))
        edges = _edges(counts)[_edges(lengths)]
        codes = chunks.indices.to_numpy(zero_copy_only=False)
        ids, counts = _spread(ids, np.diff(edges), codes)
        return pa.ListArray.from_arrays(pa.array(_edges(counts)[chunks_of_text], pa.int32()), pa.array(ids, pa.int32()))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def codec(path: str, pattern: str) -> Codec:
    """The worker process's own codec for a rank file."""
    made = words.kept_in_process("codecs", dict)
    if (path, pattern) not in made:
        made[path, pattern] = Codec(path, pattern)
    return made[path, pattern]


def _with(own: Aside, run, name: str, kind: T.DataType) -> DataFrame:
    return own.back(own.rows.mapInArrow(run, T.StructType([*own.rows.schema.fields, T.StructField(name, kind)])), name)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", output: str = "ids") -> DataFrame:
    """All columns and the ids of ``text`` (null: none), as the rank file's BPE gives them."""
    own = Aside(df)
    return _with(own, _encoder(path, pattern, own.of(text), output), output, T.ArrayType(T.IntegerType()))


def _encoder(path: str, pattern: str, text: str, output: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for block in words.blocks(batch, text):
                ids = own.encode(words.strings(block, text))
                yield pa.RecordBatch.from_arrays([*block.columns, ids], names=[*block.schema.names, output])

    return run


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", output: str = "decoded") -> DataFrame:
    """All columns and the bytes that the ids stand for (null: none)."""
    aside = Aside(df)
    ids = aside.of(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids))
            decoded = pa.array([own.decode(x or []) for x in lists.to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, decoded], names=[*batch.schema.names, output])

    return _with(aside, run, output, T.BinaryType())


ROUND_TRIP = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, n_bytes bigint"


def round_trip(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Number and digests of each text's ids, and the digest of the bytes decoded from those ids.

    The same codec as ``encode`` and ``decode``, in one pass and without carrying the ids through
    Spark.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        decimal = list(map(str, range(len(own.tokens))))
        for batch in batches:
            for block in words.blocks(batch, text):
                lists = own.encode(words.strings(block, text))
                flat, edges = lists.values.to_numpy(), lists.offsets.to_numpy().tolist()
                rows = []
                for start, stop in zip(edges[:-1], edges[1:], strict=True):
                    ids = flat[start:stop].tolist()
                    plain = own.decode(ids)
                    listed = ",".join(map(decimal.__getitem__, ids)).encode()
                    rows.append((len(ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256(plain).hexdigest(), len(plain)))
                counts, listed, plain, sizes = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [block.column(block.schema.get_field_index(key)).cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(listed), pa.array(plain), pa.array(sizes, pa.int64())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes"],
                )

    return df.select(key, text).mapInArrow(run, ROUND_TRIP)
