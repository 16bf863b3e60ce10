"""Near-duplicate documents by improved consistent weighted sampling.

A document is the weighted set of its runs of ``SHINGLE`` words (lower-cased; shorter texts are one
run).  A run's weight is its damped frequency in the document times its inverse document frequency.
Two documents are linked if the weighted Jaccard similarity of their sets is ``THRESHOLD`` or more, and
classes are what links connect.

1. Document frequencies come from one pass that counts into ``2**SKETCH_BITS`` buckets.  A bucket's
   mean load is a constant share of the documents, so the sketch resolves frequencies above
   ``RARE`` at every size of the corpus; rarer runs all count as ``RARE``.
2. Each document draws ``BANDS * ROWS`` samples, each hit with the probability of the weighted
   similarity; a band's samples make one key.
3. Copies collapse to one text by a hash of 128 bits.  ``linking.link`` compares the members of a bucket
   with centers and verifies every pair on the texts themselves.

Texts without words, null ones included, have no runs and are alike only to equal texts.  Rows of the
same id and text are one document.  ``keep_one`` leaves other columns as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headroom.llm import linking, words
from headroom.llm.aside import Aside
from headroom.sources.staging import stage

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 12, 4
SKETCH_BITS = 16
#: The document frequency below which runs are not told apart.
RARE = 0.02
#: How much more a rare run weighs than one that all documents have.
IDF_GAIN = 0.25
#: Words of 64 bits of a document's sketch in ``linking``; documents are larger sets than lines.
SKETCH_WORDS = 16
_FIELD = 1 << 16


def shingles(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash and count of the distinct runs, ordered by text and hash."""
    found = words.find_words(texts, words.ALPHANUMERIC, lower=True)
    h, counts = found.hashes(), found.counts()
    at = found.windows(SHINGLE)
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    runs = np.concatenate([words.window_hashes(h, at, SHINGLE), words.sequence_hashes(h, found.first[short], found.first[short + 1])])
    text = np.concatenate([found.text_of()[at], short])
    order = np.lexsort((runs, text))
    runs, text = runs[order], text[order]
    new = np.flatnonzero(np.concatenate([[True], (runs[1:] != runs[:-1]) | (text[1:] != text[:-1])])) if len(runs) else np.empty(0, np.int64)
    return text[new], runs[new], np.diff(np.append(new, len(runs)))


def _bucket(runs: np.ndarray) -> np.ndarray:
    return (runs >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def idf_table(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The factor of each bucket, from 1 (in every document) to ``1 + IDF_GAIN`` (rare)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(1 << SKETCH_BITS, dtype=np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for block in words.blocks(batch, text):
                _, runs, _ = shingles(words.strings(block, text))
                total += np.bincount(_bucket(runs), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], n))], names=["bucket", "n"])

    counted = docs.select(text).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    n = max(1, int(counted.loc[counted["bucket"] < 0, "n"].sum()))
    own = counted[counted["bucket"] >= 0]
    loads = np.zeros(1 << SKETCH_BITS)
    loads[own["bucket"]] = own["n"]
    frequency = np.clip((loads - loads.mean()) / n, RARE, 1.0)
    return (1 + IDF_GAIN * np.log(frequency) / np.log(RARE)).astype(np.float32)


def weights(runs: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return (1 + np.log(counts)).astype(np.float32) * idf[_bucket(runs)]


def _gamma_quantiles() -> np.ndarray:
    """Quantiles of the gamma distribution of shape 2, by Newton's method."""
    u = (np.arange(_FIELD) + 0.5) / _FIELD
    x = np.sqrt(2 * u)
    for _ in range(60):
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - u) / (x * np.exp(-x)), x / 4)
    return x


def samples(text: np.ndarray, runs: np.ndarray, weight: np.ndarray, n_texts: int, draws: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts that have runs, and ``draws`` consistent samples of each (one row a text)."""
    begin = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]])) if len(text) else np.empty(0, np.int64)
    own = text[begin]
    sizes = np.diff(np.append(begin, len(text)))
    r_of, log_c = words.kept_in_process("icws", lambda: (lambda g: (g.astype(np.float32), np.log(g).astype(np.float32)))(_gamma_quantiles()))
    log_w = np.log(weight)
    out = np.empty((len(begin), draws), dtype=np.uint64)
    if not len(begin):
        return own, out
    for k in range(draws):
        z = words.mix(runs + np.uint64((k + 1) * words.BASES[0] % (1 << 64)))
        r = r_of[z & np.uint64(_FIELD - 1)]
        beta = ((z >> np.uint64(16)) & np.uint64(_FIELD - 1)).astype(np.float32) / np.float32(_FIELD)
        t = np.floor(log_w / r + beta)
        # the logarithm of c / (y * exp(r)), with log y = r * (t - beta)
        a = log_c[z >> np.uint64(48)] - r * (t - beta + 1)
        least = np.minimum.reduceat(a, begin)
        hit = np.flatnonzero(a == np.repeat(least, sizes))
        first = hit[np.searchsorted(hit, begin)]
        out[:, k] = words.mix(runs[first] ^ words.mix(t[first].astype(np.int64).view(np.uint64) + np.uint64(k)))
    return own, out


def _signer(idf: np.ndarray, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in words.blocks(batch, "text"):
                text, runs, counts = shingles(words.strings(block, "text"))
                own, drawn = samples(text, runs, weights(runs, counts, idf), block.num_rows, bands * rows)
                keys = np.empty((len(own), bands), dtype=np.uint64)
                for b in range(bands):
                    key = np.full(len(own), b + 1, dtype=np.uint64)
                    for k in range(b * rows, (b + 1) * rows):
                        key = words.mix(key + drawn[:, k])
                    keys[:, b] = key
                edges = np.zeros(block.num_rows + 1, dtype=np.int64)
                edges[own + 1] = bands
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum(edges), pa.int32()), pa.array(keys.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(block.column(c) for c in range(3)), lists], names=["doc", "t1", "t2", "keys"])

    return run


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Similarity of two weighted sets, given as ordered hashes and weights."""
    at = np.minimum(np.searchsorted(a[0], b[0]), max(len(a[0]) - 1, 0))
    both = np.flatnonzero(a[0][at] == b[0]) if len(a[0]) else np.empty(0, np.int64)
    wa, wb = a[1][at[both]].astype(float), b[1][both].astype(float)
    low = np.minimum(wa, wb).sum()
    total = a[1].sum(dtype=float) + b[1].sum(dtype=float) - low
    return float(low / total) if total else 0.0


def _verifier(idf: np.ndarray):
    def sets(texts: pa.LargeStringArray):
        text, runs, counts = shingles(texts)
        w = weights(runs, counts, idf)
        edges = np.searchsorted(text, np.arange(len(texts) + 1))
        return [(runs[i:j], w[i:j]) for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in words.blocks(batch, "text_a"):
                sims = [weighted_jaccard(x, y) for x, y in zip(sets(words.strings(block, "text_a")), sets(words.strings(block, "text_b")), strict=True)]
                yield pa.RecordBatch.from_arrays([block.column(0), block.column(1), pa.array(sims, pa.float64())], names=["a", "b", "sim"])

    return run


def _named(df: DataFrame, key: str, text: str) -> DataFrame:
    plain = F.coalesce(F.col(text), F.lit(""))
    return df.select(F.col(key).cast("long").alias("doc"), F.xxhash64(plain).alias("t1"), F.xxhash64(F.lit("second"), plain).alias("t2"), plain.alias("text"))


def classes(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc``, ``t1``, ``t2`` (hashes of its text) and ``class_id``, the least key of its class."""
    words.small_batches(df.sparkSession)
    docs = _named(df, key, text)
    idf = idf_table(docs)
    signed = stage(docs.mapInArrow(_signer(idf, bands, rows), "doc long, t1 long, t2 long, keys array<long>"), "signed")
    distinct = stage(signed.groupBy("t1", "t2").agg(F.min("doc").alias("least"), F.first("keys").alias("keys")), "texts")
    members = distinct.select(F.explode("keys").alias("key"), F.col("t1").alias("node"))

    texts = None

    def prepare(nodes: DataFrame) -> None:
        nonlocal texts
        wanted = stage(distinct.join(nodes, distinct["t1"] == nodes["node"]).select("t1", "t2", "least"), "wanted")
        found = linking.among(docs, "t1", wanted, "t1").join(wanted, ["t1", "t2"]).where(F.col("doc").eqNullSafe(F.col("least")))
        texts = stage(found.select(F.col("t1").alias("node"), "text"), "candidates")

    def compare(pairs: DataFrame) -> DataFrame:
        both = linking.with_texts(pairs, texts, "text")
        return both.mapInArrow(_verifier(idf), "a long, b long, sim double").groupBy("a", "b").agg(F.max("sim").alias("sim"))

    def sketch(nodes: DataFrame) -> DataFrame:
        def sets(block):
            own, runs, counts = shingles(block)
            return own, runs, weights(runs, counts, idf)

        return linking.sketches(texts, "text", sets, SKETCH_WORDS)

    roots = linking.link(members, compare, threshold, prepare, sketch=sketch)
    if roots is None:
        least = distinct.select("t1", "t2", F.col("least").alias("class_id"))
    else:
        rooted = distinct.join(roots, distinct["t1"] == roots["node"], "left").select("t1", "t2", "least", F.coalesce("root", "t1").alias("root"))
        of_root = rooted.groupBy("root").agg(F.min("least").alias("class_id"))
        least = rooted.join(of_root, "root").select("t1", "t2", "class_id")
    return signed.select("doc", "t1", "t2").join(least, ["t1", "t2"])


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The table with one document of each class, the one with the least key."""
    own = Aside(df)
    key, text = own.of(key), own.of(text)
    gone = classes(own.rows, key, text, **settings).where(~F.col("doc").eqNullSafe(F.col("class_id")))
    gone = stage(gone.select("doc", "t1", "t2").distinct(), "gone")
    plain = F.coalesce(F.col(text), F.lit(""))
    rows = own.rows.withColumns({"doc": F.col(key).cast("long"), "t1": F.xxhash64(plain), "t2": F.xxhash64(F.lit("second"), plain)})
    same = [rows["doc"].eqNullSafe(gone["doc"]), rows["t1"] == gone["t1"], rows["t2"] == gone["t2"]]
    return own.back(rows.join(gone, same, "left_anti"))
