"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again.

Every stage but the last returns the columns of ``documents``, and ``n_chars`` follows the text.

* quality: documents that the base rules or the learned list reject go.
* line_dedup: repeated lines are cut out; a document that loses all its words by that goes.
* near_dedup: one document of each class of near-duplicates stays, the one with the least id.
* decontamination: benchmark passages are cut out; documents mostly made of them go.
* byte_bpe: per document, number and digests of its ids and of the bytes decoded from them.

Null and empty texts have too few words and go in the first stage; an empty table stays empty.  Equal rows are judged alike,
stay together as one document in ``near_dedup``, and a null id counts as the largest.  Other columns come through unchanged,
whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headroom.llm import bytebpe, decontaminate, fuzzylines, neardup, quality
from headroom.llm.aside import Aside
from headroom.llm.catalog import BYTE_BPE, table
from headroom.sources.staging import stage


def _sized(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.length("text").cast(df.schema["n_chars"].dataType))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rules = quality.learn(docs, table(spark, sf_dir, "labels"))
    return quality.keep(docs, rules)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own = Aside(docs)
    text = own.of("text")
    out = fuzzylines.dedup_lines(own.rows, own.of("doc_id"), text, removed="removed")
    return _sized(own.back(out.where((F.col("removed") == 0) | F.col(text).rlike(r"[^\x20\x09-\x0D]"))))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _sized(decontaminate.remove_hits(docs, table(spark, sf_dir, "benchmark")))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bytebpe.round_trip(docs, BYTE_BPE, public_tokenizers.PATTERN).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]

#: Learned rules, similarity classes and BPE are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs
