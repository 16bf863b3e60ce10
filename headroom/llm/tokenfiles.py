"""Token ids in Parquet files that answer questions about tokens or metadata alone.

A file has a row for each document, in ascending order of its key: the key, the number of ids, and
the ids as a list column.  Writers dictionary-encode the list and fall back to delta packing (format
version 2) where a dictionary doesn't pay; row groups and pages have a set size, and page indexes let
a reader with a filter on the key skip pages.  File names ascend with the keys they hold, so the
stream of all ids is the files one after the other.

The vocabulary comes from a file of the tokenizers library.  Texts are cut at ASCII white space,
which that tokenizer drops.  Words of plain Latin characters are cut into the file's pre-tokens on whole
blocks of bytes, by the class of each character; a block's distinct pre-tokens are lower-cased and merged by
the library's model.  Words with an apostrophe are lower-cased and split by the file's pattern one by one, other
words are normalised and split by the library too, and words with white space beyond ASCII or with
the text of an added token (``<|endoftext|>``) go through the whole library as they are.

Null texts count as empty and have the end id alone.  Rows with the same key are all written, side
by side.  Columns other than key and text are not read.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from headroom.llm import words

#: Larger blocks repeat more words.
BLOCK_BYTES = 6 << 20
#: Bytes of a row group and of a page, and the pre-tokens and other words that a worker process remembers.
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
CACHED = 500_000
ODD_SPACE = regex.compile(r"[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200d\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")
#: Words of these characters have one normal form, their lower case, and are split below.
LATIN = regex.compile(r"[!-~\xa1-\xac\xae-\u024f]+")
#: Fixed value: the tokenizer file's own pattern of pre-tokens.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _byte_letters() -> dict[int, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(other)}


#: Classes of characters; a word with one that is ``SLOW`` isn't cut on bytes.
OTHER, LETTER, NUMBER, SLOW = range(4)


def _classes() -> np.ndarray:
    """The class of each character that two bytes can hold."""
    found = np.full(1 << 11, SLOW, dtype=np.uint8)
    for c in map(chr, range(0x250)):
        # an apostrophe may begin a contraction, and a lower case of another class or length moves cuts
        if c != "'" and LATIN.fullmatch(c) and len(c.lower()) == 1:
            found[ord(c)], low = (LETTER if regex.match(r"\p{L}", x) else NUMBER if regex.match(r"\p{N}", x) else OTHER for x in (c, c.lower()))
            if found[ord(c)] != low:
                found[ord(c)] = SLOW
    return found


class Encoder:
    """Ids of texts by a tokenizer file whose pre-tokens never reach over white space."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = regex.compile("|".join(map(regex.escape, added)) or "(?!)", regex.IGNORECASE).search
        self.cache: dict[str, bytes] = {}
        self.letters = _byte_letters()
        pattern = json.loads(self.tokenizer.to_str())["pre_tokenizer"]["pretokenizers"][0]["pattern"].get("Regex")
        # any other file is split by the library alone
        self.split = regex.compile(PRE_TOKENS).findall if pattern == PRE_TOKENS else None
        self.classes = _classes()
        signs = [regex.search(r"[!-/:-@\[-`{-~]", t) for t in added]
        if self.split is None or not all(signs):
            self.classes[:] = SLOW
        # an added token holds its first sign in any case
        self.classes[[ord(s[0]) for s in signs if s]] = SLOW

    def _by_library(self, word: str) -> bytes:
        return array("i", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def _remember(self, piece: str, in_letters: str) -> bytes:
        ids = array("i", [t.id for t in self.tokenizer.model.tokenize(in_letters)]).tobytes()
        self.cache[piece] = ids
        return ids

    def _latin(self, word: str) -> bytes:
        """Ids of a word of Latin characters: lower case, split, and merged by the library."""
        ids = b""
        for piece in self.split(word.lower()):
            own = self.cache.get(piece)
            ids += self._remember(piece, piece.encode().decode("latin-1").translate(self.letters)) if own is None else own
        return ids

    def units(self, distinct: list[str], slow: np.ndarray) -> list[bytes]:
        """The ids of each pre-token, or word if it is slow, as bytes of 32-bit integers."""
        if len(self.cache) >= CACHED:
            self.cache.clear()
        cache = self.cache
        ids = list(map(cache.get, distinct))
        new = [i for i, own in enumerate(ids) if own is None]
        whole = [i for i in new if slow[i]]
        words_ = [distinct[i] for i in whole]
        for i, word, own in zip(whole, words_, self._new_words(words_), strict=True):
            ids[i] = cache[word] = own
        for i in new:
            if ids[i] is None:
                piece = distinct[i]
                low = piece.lower()
                own = cache.get(low)
                if own is None:
                    own = self._remember(low, low if low.isascii() else low.encode().decode("latin-1").translate(self.letters))
                ids[i] = cache[piece] = own
        return ids

    def _new_words(self, distinct: list[str]) -> list[bytes]:
        whole = {i: self._by_library(w) for i, w in enumerate(distinct) if self.added(w)}
        if whole:
            rest = iter(self._new_words([w for i, w in enumerate(distinct) if i not in whole]))
            return [whole[i] if i in whole else next(rest) for i in range(len(distinct))]
        if self.split is None:
            return self._by_steps(distinct)
        latin = LATIN.fullmatch
        ids = [self._latin(w) if latin(w) else None for w in distinct]
        other = [i for i, own in enumerate(ids) if own is None]
        for i, own in zip(other, self._by_steps([distinct[i] for i in other]), strict=True):
            ids[i] = own
        return ids

    def _by_steps(self, distinct: list[str]) -> list[bytes]:
        """Any words: the library's normaliser, splitter and model one after the other."""
        odd = [i for i, w in enumerate(distinct) if not w.isascii() and ODD_SPACE.search(w) or w.isascii() and not w.isprintable()]
        plain = distinct if not odd else [w for i, w in enumerate(distinct) if i not in set(odd)]
        normal = self.tokenizer.normalizer.normalize_str(" ".join(plain)) if plain else ""
        parts = normal.split(" ")
        if plain and len(parts) != len(plain):
            return [self._by_library(w) for w in distinct]
        edges = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1)
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str(normal) if normal else []
        at = np.searchsorted(edges, np.fromiter((s[1][0] for s in split), dtype=np.int64, count=len(split)), side="right")
        ids = [b""] * len(plain)
        for i, (piece, _) in zip(at.tolist(), split, strict=True):
            ids[i] += array("i", [t.id for t in self.tokenizer.model.tokenize(piece)]).tobytes()
        if odd:
            rest = iter(ids)
            special = set(odd)
            ids = [self._by_library(w) if i in special else next(rest) for i, w in enumerate(distinct)]
        return ids

    def _cut(self, found: words.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words without what is between them: their bytes, the edges of units in these, which are slow, and the first unit of each text."""
        sizes = found.ends - found.starts
        edges = np.concatenate([[0], np.cumsum(sizes)])
        data = found.data[words.NOT_BLANK[found.data]]
        class_ = self.classes[data]
        class_[data >= 0x80] = SLOW
        lead = np.flatnonzero((data >= 0xC2) & (data < 0xCA))
        class_[lead] = class_[lead + 1] = self.classes[((data[lead] & 0x1F).astype(np.int64) << 6) | (data[lead + 1] & 0x3F)]
        slow = np.zeros(len(data), dtype=bool)
        if len(sizes):
            slow_word = np.maximum.reduceat(class_, edges[:-1]) == SLOW
            slow = np.repeat(slow_word, sizes)
        # fewer distinct pre-tokens; slow words are lower-cased later, as added tokens have a case
        data = np.where(slow, data, words.LOWER[data])
        begins = np.ones(len(data), dtype=bool)
        begins[1:] = (class_[1:] != class_[:-1]) | (class_[1:] == NUMBER)
        begins &= ((data & 0xC0) != 0x80) & ~slow
        begins[edges[:-1]] = True
        at = np.flatnonzero(begins)
        return data, np.append(at, len(data)), slow[at], np.searchsorted(at, edges[found.first])

    def encode(self, texts: pa.LargeStringArray, end: int) -> pa.ListArray:
        """The ids of each text, and ``end`` after them."""
        data, edges, slow, first = self._cut(words.find_words(texts))
        listed = pa.LargeStringArray.from_buffers(len(slow), pa.py_buffer(edges), pa.py_buffer(data)).dictionary_encode()
        codes = listed.indices.to_numpy(zero_copy_only=False)
        slow_unit = np.zeros(len(listed.dictionary), dtype=bool)
        slow_unit[codes] = slow
        ids = self.units(listed.dictionary.to_pylist(), slow_unit)
        # the end id is one unit more, after those of each text
        flat = np.append(np.frombuffer(b"".join(ids), dtype=np.int32), np.int32(end))
        counts = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        begins = np.append(np.cumsum(counts) - counts, len(flat) - 1)
        codes = np.insert(codes, first[1:], len(ids))
        sizes = np.append(counts, 1)[codes]
        ends = np.cumsum(sizes)
        own = flat[np.repeat(begins[codes] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]
        at = np.concatenate([[0], ends])[first + np.arange(len(first))]
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(own, pa.int32()))


def write(df: DataFrame, folder: str, tokenizer: str, end: int, key: str = "doc_id", text: str = "text") -> None:
    """Encode a table and write its files.

    The texts are dealt to files by ranges of the key, so that a file's rows are encoded where they
    are written and ids never travel.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = words.kept_in_process(f"tokenizer {tokenizer}", lambda: Encoder(tokenizer))
        for batch in batches:
            for block in words.blocks(batch, text, BLOCK_BYTES):
                ids = own.encode(words.strings(block, text), end)
                keys = block.column(block.schema.get_field_index(key)).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([keys, pc.list_value_length(ids).cast(pa.int64()), ids], names=[key, "n_tokens", "ids"])

    ordered = df.select(key, text).repartitionByRange(key).sortWithinPartitions(key)
    encoded = ordered.mapInArrow(run, f"{key} bigint, n_tokens bigint, ids array<int>")
    encoded.write.option("parquet.writer.version", "PARQUET_2_0").option("parquet.enable.dictionary", "true").option("parquet.block.size", ROW_GROUP_BYTES).option("parquet.page.size", PAGE_BYTES).option("compression", "zstd").parquet(folder)


def read(spark: SparkSession, folder: str, key: str = "doc_id") -> DataFrame:
    """Key, ``n_tokens`` and ``ids``; select fewer columns to read less."""
    return spark.read.schema(f"{key} bigint, n_tokens bigint, ids array<int>").parquet(folder)


def offsets(spark: SparkSession, folder: str, key: str = "doc_id") -> DataFrame:
    """Place of each document's first id in the stream, from the metadata columns alone."""
    rows = read(spark, folder, key).select(key, "n_tokens", F.col("_metadata.file_name").alias("file"))
    return with_offsets(rows, key).drop("file")


def with_offsets(rows: DataFrame, key: str, sizes: DataFrame | None = None) -> DataFrame:
    """Add ``start`` to rows that have ``file``, the key and ``n_tokens``.

    Sums by file are few; running sums stay within a file, whose size is bounded.  ``sizes`` has ``file`` and
    ``n_tokens`` of the same documents, where the rows themselves cost more to make twice.
    """
    files = (rows if sizes is None else sizes).groupBy("file").agg(F.sum("n_tokens").alias("total"))
    # by number, since the name of file 100000 sorts before that of 99999
    number = F.regexp_extract("file", r"part-(\d+)", 1).cast("long")
    before = Window.orderBy(number, "file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("file").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("within", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return rows.join(files, "file").withColumn("start", F.col("before") + F.col("within")).drop("before", "within")


def summary(spark: SparkSession, folder: str, key: str = "doc_id") -> DataFrame:
    """Per document, read from the files: key, start, number and checksum of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("ids"))
            edges = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            sums = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(key)), pa.array(np.diff(edges), pa.int64()), pa.array(sums, pa.int64()), batch.column(batch.schema.get_field_index("file"))],
                names=[key, "n_tokens", "ids_crc32", "file"],
            )

    stored = read(spark, folder, key).select(key, "n_tokens", "ids", F.col("_metadata.file_name").alias("file"))
    rows = stored.select(key, "ids", "file").mapInArrow(run, f"{key} bigint, n_tokens bigint, ids_crc32 bigint, file string")
    # the files' totals need no ids
    return with_offsets(rows, key, stored.select("file", "n_tokens")).select(key, "start", "n_tokens", "ids_crc32")
