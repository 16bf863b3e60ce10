"""A left join that frequent keys don't slow down."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headroom.operators.series import LONG_SERIES_FACTOR, LONG_SERIES_FLOOR, frequent_keys

_SALT, _FOUND = "_salt", "_found"


def split_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    floor: int = LONG_SERIES_FLOOR,
    factor: float = LONG_SERIES_FACTOR,
) -> DataFrame:
    """Left join with a side that has at most one row for a key.

    Keys with more than ``max(floor, factor * rows / partitions)`` rows on the left are counted map-side.
    There are at most ``partitions / factor`` of them, so their rows of ``right`` are broadcast, and their rows
    on the left take part in the shuffle under a salt of their own instead of meeting in one task.  All others join
    as usual.  The left side is read and shuffled once.
    """
    added = [c for c in right.columns if c not in keys]
    frequent = frequent_keys(left, keys, floor, factor)
    if not frequent.keys:
        return left.join(right, keys, "left")
    spark = left.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    listed = spark.createDataFrame(frequent.keys, left.select(*keys).schema)
    # listed keys without a partner are frequent all the same
    known = listed.join(right, keys, "left").select(*keys, F.struct(F.lit(True).alias("frequent"), *added).alias(_FOUND))
    marked = left.join(F.broadcast(known), keys, "left")
    spread = 1 + F.pmod(F.xxhash64(*left.columns), F.lit(4 * partitions))
    salted = marked.withColumn(_SALT, F.when(F.col(_FOUND).isNotNull(), spread).otherwise(F.lit(0).cast("long")))
    # always 0, but no constant: one would be moved out of the join's keys
    unsalted = right.withColumn(_SALT, F.xxhash64(*keys) % 1)
    joined = salted.join(unsalted, [*keys, _SALT], "left")
    return joined.select(
        *left.columns,
        *[F.when(F.col(_FOUND).isNotNull(), F.col(f"{_FOUND}.{c}")).otherwise(F.col(c)).alias(c) for c in added],
    )
