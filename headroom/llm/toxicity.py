"""Toxicity by logistic regression, learned with FTRL-proximal on hashed word features.

Features of a text are its words, its pairs of neighbours and its pairs with one word between,
lower-cased and hashed to ``2**bits`` coordinates; each counts once a text.  FTRL-proximal keeps
two numbers a coordinate, gives each its own rate, and its L1 term leaves most weights at zero, so
that the model is a short list of coordinates and weights.

Learning uses at most about ``SAMPLE_ROWS`` labelled rows, those with the smallest hashes.  They are
dealt to ``shards`` groups, each learns alone, and weights are averaged by coordinate in Spark.  One
group, the default, follows the method's own order of updates and is more accurate; its size is
bounded by the sample.  The driver sees weights that are not zero, never texts.  Scoring reads all
rows in one pass without a shuffle.

Null and empty texts have no features and get the score of the bias alone.  Without any labelled
row, or with labels of one kind only, all scores are the share of toxic labels (0 if there are
none).  Labels that are null, or of no document, are left out; a repeated label row counts as often as it stands there.
Scores hang on the text alone, so repeated rows have equal ones and a null id is scored like any other.  An input column
named like ``output`` gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from headroom.llm import words
from headroom.llm.aside import Aside

BITS = 20
SAMPLE_ROWS = 20_000
SHARDS = 1
EPOCHS = 5
ALPHA, BETA, L1, L2 = 1.0, 1.0, 4.0, 0.3
#: Multipliers that keep single words, neighbours and skipping pairs apart.
KINDS = (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


@dataclass(frozen=True)
class Model:
    bits: int
    bias: float
    coordinates: np.ndarray
    weights: np.ndarray


def features(texts: pa.LargeStringArray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and coordinate of every feature, with repetitions."""
    found = words.find_words(texts, words.ALPHANUMERIC, lower=True)
    h, text_of = found.hashes(), found.text_of()
    texts_, coordinates = [], []
    for kind, gap in zip(KINDS, (0, 1, 2), strict=True):
        at = found.windows(gap + 1)
        value = h[at] * np.uint64(kind)
        if gap:
            value = value + words.mix(h[at + gap] + np.uint64(kind))
        coordinates.append((words.mix(value) >> np.uint64(64 - bits)).astype(np.int64))
        texts_.append(text_of[at])
    return np.concatenate(texts_), np.concatenate(coordinates)


def _rows(bits: int, carry: list[str], text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in words.blocks(batch, text):
                text_of, coordinate = features(words.strings(block, text), bits)
                keys = np.unique(text_of << bits | coordinate)
                edges = np.searchsorted(keys, np.arange(block.num_rows + 1) << bits)
                lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(keys & ((1 << bits) - 1), pa.int32()))
                kept = [block.column(block.schema.get_field_index(c)) for c in carry]
                yield pa.RecordBatch.from_arrays([*kept, lists], names=[*carry, "features"])

    return run


def _weights(z: np.ndarray, n: np.ndarray, bias: np.ndarray, settings: tuple[float, float, float, float]) -> np.ndarray:
    """Weights that a state stands for; the bias is not held at zero."""
    alpha, beta, l1, l2 = settings
    held = np.where(bias, 0.0, l1)
    return np.where(np.abs(z) > held, (np.sign(z) * held - z) / ((beta + np.sqrt(n)) / alpha + l2), 0.0)


def _learner(bits: int, epochs: int, settings: tuple[float, float, float, float]):
    """FTRL-proximal over the rows of a group; yields the weights that are not zero, the bias last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True)]
        rows.sort(key=lambda r: r[0])
        z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
        for _ in range(epochs if rows else 0):
            for _, y, listed in rows:
                at = np.append(listed.values.to_numpy(), len(z) - 1)
                own_n = n[at]
                w = _weights(z[at], own_n, at == len(z) - 1, settings)
                g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
                z[at] += g - (np.sqrt(own_n + g * g) - np.sqrt(own_n)) / settings[0] * w
                n[at] += g * g
        w = _weights(z, n, np.arange(len(z)) == len(z) - 1, settings)
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(w[at])], names=["at", "w"])

    return run


def train(sample: DataFrame, bits: int = BITS, shards: int = SHARDS, epochs: int = EPOCHS, settings=(ALPHA, BETA, L1, L2)) -> Model:
    """A model from rows of ``sampling.labelled_sample``."""
    totals = sample.agg(F.count("y").alias("rows"), F.sum("y").alias("toxic")).first()
    share = totals["toxic"] / totals["rows"] if totals["rows"] else 0.0
    if share in (0.0, 1.0):
        p = min(max(share, 1e-9), 1 - 1e-9)
        return Model(bits, float(np.log(p / (1 - p))), np.empty(0, np.int64), np.empty(0))
    rows = sample.mapInArrow(_rows(bits, ["_order", "y"], "_text"), "_order long, y double, features array<int>")
    learned = rows.repartition(shards, F.col("_order")).mapInArrow(_learner(bits, epochs, settings), "at long, w double")
    mean = learned.groupBy("at").agg((F.sum("w") / shards).alias("w")).toPandas()
    at, w = mean["at"].to_numpy(), mean["w"].to_numpy()
    bias = at == 1 << bits
    return Model(bits, float(w[bias].sum()), at[~bias], w[~bias])


def score(df: DataFrame, model: Model, text: str = "text", output: str = "score") -> DataFrame:
    """All columns and the probability that the text is toxic."""
    own = Aside(df)
    text = own.of(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(1 << model.bits)
        dense[model.coordinates] = model.weights
        for batch in batches:
            for block in words.blocks(batch, text):
                text_of, coordinate = features(words.strings(block, text), model.bits)
                some = np.flatnonzero(dense[coordinate])
                keys = np.unique(text_of[some] << model.bits | coordinate[some])
                total = model.bias + np.bincount(keys >> model.bits, dense[keys & ((1 << model.bits) - 1)], block.num_rows)
                p = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
                yield pa.RecordBatch.from_arrays([*block.columns, pa.array(p)], names=[*block.schema.names, output])

    scored = own.rows.mapInArrow(run, T.StructType([*own.rows.schema.fields, T.StructField(output, T.DoubleType())]))
    return own.back(scored, output)
