"""Reading trace tables and the tables that later steps exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from headroom import contracts as C
from headroom.functions.columns import nan_to_null, present
from headroom.operators.ordering import first_rows
from headroom.operators.series import LONG_SERIES_FACTOR, LONG_SERIES_FLOOR, frequent_keys
from headroom.sources.staging import stage


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A Parquet table with missing values as NULL."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return nan_to_null(reader.parquet(path))


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV table with a header, typed by its declared schema (no inference pass)."""
    reader = spark.read.schema(schema).options(header=True, quote='"', escape='"')
    return nan_to_null(reader.csv(path))


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def with_row_id(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the ``row_id`` that breaks ties, numbered in file order if it has none.

    Numbered rows are stored before use, so that every later pass sees the same numbers.
    """
    if "row_id" in df.columns:
        return df
    return stage(df.withColumn("row_id", F.monotonically_increasing_id()), name)


def flatten_usage(source: DataFrame) -> DataFrame:
    """Unpack the usage structs; Catalyst reads only the nested fields that are used."""
    unpacked = {
        "avg_cpu": F.col("average_usage.cpus"),
        "avg_memory": F.col("average_usage.memory"),
        "max_cpu": F.col("maximum_usage.cpus"),
        "max_memory": F.col("maximum_usage.memory"),
    }
    flat = source.withColumns(unpacked)
    return flat.select(*present(flat, C.USAGE.fieldNames()))


def flatten_instance_events(source: DataFrame) -> DataFrame:
    flat = source.withColumns(
        {
            "resource_request_cpu": F.col("resource_request.cpus"),
            "resource_request_memory": F.col("resource_request.memory"),
        }
    )
    return flat.select(*present(flat, C.INSTANCE_EVENTS.fieldNames()))


def flatten_machine_events(source: DataFrame) -> DataFrame:
    flat = source.withColumns(
        {"capacity_cpu": F.col("capacity.cpus"), "capacity_memory": F.col("capacity.memory")}
    )
    return flat.select(*present(flat, C.MACHINE_EVENTS.fieldNames()))


def extract_usage(
    source: DataFrame,
    first_us: int = 0,
    last_us: int = C.SEVEN_DAYS_US,
    row_cap: int | None = None,
) -> DataFrame:
    """Usage rows that start within the period (both ends included), earliest first if capped.

    Every row is kept unless a cap is asked for, which keeps the first rows by time, so a
    capped extract is reproducible.  Keys of a series may be missing at this stage, so they play no part
    in the order.
    """
    period = source.where(F.col("start_time").between(first_us, last_us))
    rows = flatten_usage(with_row_id(period, "usage"))
    return rows if row_cap is None else first_rows(rows, row_cap, C.SERIES_ORDER)


def extract_instance_events(
    source: DataFrame,
    usage: DataFrame,
    floor: int = LONG_SERIES_FLOOR,
    factor: float = LONG_SERIES_FACTOR,
) -> DataFrame:
    """Events of the collections that occur in ``usage``.

    A semi join: the collection ids stay on the executors, and distinct ids are formed
    before they move.  Collections with too many events for a task are few (at most
    ``partitions / factor``), so those are looked up in a broadcast table and their events
    are not shuffled at all.
    """
    key = ["collection_id"]
    seen = distinct_keys(usage, *key)
    frequent = frequent_keys(source, key, floor, factor).keys
    if frequent:
        schema = source.select(*key).schema
        often = F.broadcast(source.sparkSession.createDataFrame(frequent, schema))
        seen_often = F.broadcast(seen.join(often, key, "left_semi"))
        rest = source.join(often, key, "left_anti").join(seen, key, "left_semi")
        events = source.join(seen_often, key, "left_semi").unionByName(rest)
    else:
        events = source.join(seen, key, "left_semi")
    events = events.select(*source.columns)
    return flatten_instance_events(with_row_id(events, "instance_events"))


def distinct_keys(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-null values of a column."""
    return df.where(F.col(column).isNotNull()).select(column).distinct()


def extract_machine_events(
    source: DataFrame, types: tuple[int, ...] = C.MACHINE_TYPES
) -> DataFrame:
    """Machine rows that carry capacity information."""
    return flatten_machine_events(source.where(F.col("type").isin(*types)))


def read_predictions(
    spark: SparkSession, path: str, models: list[str] | None = None
) -> DataFrame:
    """Predictions of the wanted models; a model without a partition contributes no rows."""
    rows = read_parquet(spark, path, C.PREDICTIONS)
    return rows if models is None else rows.where(F.col("model").isin(*models))
