"""Canonical trace tables projected out of the test tables under ``sf_dir``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WINDOW_US = 300_000_000
EVENTS_EPOCH = "2024-01-01"
UNIX_EPOCH = "1970-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _micros_since(epoch: str, column: str) -> Column:
    """Microseconds since ``epoch``; the columns carry no zone and none is assumed.

    Built from the parts of the interval: ``timestampdiff`` would go through the session
    time zone and miscount across its clock changes.
    """
    elapsed = F.col(column) - F.expr(f"TIMESTAMP_NTZ'{epoch}'")
    part = lambda unit: F.extract(F.lit(unit), elapsed)
    seconds = (part("DAY").cast("long") * 24 + part("HOUR")) * 3600 + part("MINUTE") * 60
    return seconds * 1_000_000 + _long(part("SECOND") * 1_000_000)


def _long(value: Column) -> Column:
    return value.cast("long")


def usage_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``instance_usage`` rows from ``events``, without the distribution arrays."""
    event, user = F.col("event_id"), F.col("user_id")
    start = _micros_since(EVENTS_EPOCH, "ts")
    memory = F.get_json_object("props", "$.k").cast("double") / 100
    no_id = F.lit(None).cast("long")
    return table(spark, sf_dir, "events").select(
        start.alias("start_time"),
        (start + WINDOW_US).alias("end_time"),
        user.alias("collection_id"),
        _long(event % 2).alias("instance_index"),
        _long(user % 10).alias("machine_id"),
        no_id.alias("alloc_collection_id"),
        no_id.alias("alloc_instance_index"),
        _long(event % 2).alias("collection_type"),
        (F.col("value") / 500).alias("avg_cpu"),
        memory.alias("avg_memory"),
        (F.col("value") / 400).alias("max_cpu"),
        (memory * 1.25).alias("max_memory"),
        F.lit(1.0).alias("assigned_memory"),
        (1 + (event % 5) / 10).alias("cycles_per_instruction"),
        ((event % 7) / 1000).alias("memory_accesses_per_instruction"),
        F.lit(1.0).alias("sample_rate"),
        event.alias("row_id"),
    )


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``instance_usage`` with both distribution arrays taken from ``embeddings``.

    Rows take the vectors in turn, all of them: ``vec_id`` counts from 0 without gaps.
    """
    as_curve = lambda first, n: F.slice("embedding", first, n).cast("array<double>")
    vectors = table(spark, sf_dir, "embeddings")
    turn = F.col("row_id") % max(1, vectors.count())
    curves = vectors.select(
        F.col("vec_id"),
        as_curve(1, 11).alias("cpu_usage_distribution"),
        as_curve(12, 9).alias("tail"),
        as_curve(12, 3).alias("short_tail"),
    )
    rows = usage_rows(spark, sf_dir)
    tail = F.when(F.col("row_id") % 7 == 0, F.col("short_tail")).otherwise(F.col("tail"))
    joined = rows.join(curves, turn == F.col("vec_id"), "left")
    return joined.select(
        *rows.columns, "cpu_usage_distribution", tail.alias("tail_cpu_usage_distribution")
    )


def usage_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage in its source shape, with the measures packed as structs."""
    packed = lambda c, m: F.struct(F.col(c).alias("cpus"), F.col(m).alias("memory"))
    return usage(spark, sf_dir).withColumns(
        {
            "average_usage": packed("avg_cpu", "avg_memory"),
            "maximum_usage": packed("max_cpu", "max_memory"),
        }
    ).drop("avg_cpu", "avg_memory", "max_cpu", "max_memory")


def instance_events_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``instance_events`` in its source shape, from ``orders``."""
    order, price = F.col("o_orderkey"), F.col("o_totalprice")
    status = F.col("o_orderstatus")
    cpus = F.when(order % 11 == 0, None).when(order % 13 == 0, 0.0).otherwise(price / 2_000_000)
    return table(spark, sf_dir, "orders").select(
        _micros_since(UNIX_EPOCH, "o_orderdate").alias("time"),
        _long(F.when(status == "F", 1).when(status == "O", 0).when(status == "P", 2)).alias("type"),
        F.col("o_custkey").alias("collection_id"),
        _long(order % 2).alias("instance_index"),
        _long(F.col("o_custkey") % 10).alias("machine_id"),
        _long(F.substring("o_orderpriority", 1, 1)).alias("priority"),
        _long(order % 4).alias("scheduling_class"),
        _long(order % 2).alias("collection_type"),
        F.struct(cpus.alias("cpus"), (price / 1_000_000).alias("memory")).alias("resource_request"),
        F.lit(None).cast("long").alias("alloc_collection_id"),
        order.alias("row_id"),
    )


def machine_events_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``machine_events`` in its source shape, from ``supplier``."""
    key, balance = F.col("s_suppkey"), F.col("s_acctbal")
    return table(spark, sf_dir, "supplier").select(
        (key * 1_000_000).alias("time"),
        key.alias("machine_id"),
        _long(key % 3).alias("type"),
        F.struct((balance / 10_000).alias("cpus"), (balance / 20_000).alias("memory")).alias("capacity"),
    )
