"""Window functions over series, safe when one series holds much of the table.

Most series fit in a task and get an ordinary window.  A series far above the average
task size is cut into chunks along its own order.  Every chunk is fed copies of the few
rows before it and after it that its frames reach into, so results equal those of the
uncut window, and the copies are dropped again afterwards.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import pairwise
from math import ceil, inf

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from headroom import contracts as C
from headroom.functions.columns import all_present

CHUNK = "chunk"
LONG_SERIES_FLOOR = 1_000_000
LONG_SERIES_FACTOR = 2
SAMPLES_PER_PIECE = 400


def with_series_key(df: DataFrame) -> DataFrame:
    """Rows that belong to a series (both key columns present)."""
    return df.where(all_present(C.SERIES_KEYS))


def without_series_key(df: DataFrame) -> DataFrame:
    """The other rows, of which a key column is missing."""
    return df.where(~all_present(C.SERIES_KEYS))


def series_order() -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in C.SERIES_ORDER]


def series_window(*extra_keys: str) -> WindowSpec:
    return W.partitionBy(*C.SERIES_KEYS, *extra_keys).orderBy(*series_order())


@dataclass(frozen=True)
class SeriesCuts:
    """Long series of one table and the places where they are cut.

    ``long`` cannot exceed ``shuffle partitions / factor`` keys (each holds more than
    ``factor`` mean partitions' rows), so the driver may list it and Spark broadcast it.
    """

    rows: int
    limit: int
    long: list[tuple] = field(default_factory=list)
    times: list[int] = field(default_factory=list)
    tied_times: list[int] = field(default_factory=list)
    tied_ids: list[int] = field(default_factory=list)

    def __bool__(self) -> bool:
        return bool(self.long)

    def long_keys(self, df: DataFrame) -> DataFrame:
        """The long series' keys as a bounded table."""
        schema = df.select(*C.SERIES_KEYS).schema
        return F.broadcast(df.sparkSession.createDataFrame(self.long, schema))

    def whole_chunk(self, df: DataFrame) -> DataFrame:
        """Add the chunk that rows of whole series carry; rows of long series get none.

        Read off the key table instead of a constant, which Catalyst would fold out of the
        join keys and thereby out of the partitioning.
        """
        keys = self.long_keys(df).withColumn("is_long", F.lit(True))
        chunk = F.when(F.col("is_long"), -1).otherwise(0).cast("long")
        return df.join(keys, C.SERIES_KEYS, "left").select(*df.columns, chunk.alias(CHUNK))

    def only_long(self, df: DataFrame) -> DataFrame:
        return df.join(self.long_keys(df), C.SERIES_KEYS, "left_semi")

    def tag(self, df: DataFrame) -> DataFrame:
        """Add the chunk number: 0 for whole series, ascending from 1 inside long ones."""
        if not self:
            return df.withColumn(CHUNK, F.lit(0).cast("long"))
        keys = self.long_keys(df).withColumn("is_long", F.lit(True))
        marked = df.join(keys, C.SERIES_KEYS, "left")
        # A time too frequent for one chunk gets a cell of its own, cut further by row_id.
        after = [t + 1 for t in self.tied_times]
        edges = _distinct_as_double([*self.times, *self.tied_times, *after])
        marked, cell = _cell(marked, "start_time", edges)
        number = cell
        if self.tied_times:
            marked, id_cell = _cell(marked, "row_id", self.tied_ids)
            tied = F.col("start_time").isin(self.tied_times)
            number = cell * (len(self.tied_ids) + 2) + F.when(tied, id_cell).otherwise(0)
        chunk = F.when(F.col("is_long"), number + 1).otherwise(0).cast("long")
        return marked.withColumn(CHUNK, chunk).select(*df.columns, CHUNK)


def _cell(df: DataFrame, column: str, edges: list[int]) -> tuple[DataFrame, Column]:
    """Add the number of ``edges`` at or below ``column``; a missing value comes last.

    ``Bucketizer`` searches the edges by bisection on the JVM.
    """
    if not edges:
        return df, F.lit(0).cast("long")
    seen, cell = f"{column}_seen", f"{column}_cell"
    splits = [-inf, *[float(e) for e in edges], inf]
    bucketizer = Bucketizer(splits=splits, inputCol=seen, outputCol=cell, handleInvalid="keep")
    df = bucketizer.transform(df.withColumn(seen, F.col(column).cast("double")))
    return df, F.coalesce(F.col(cell).cast("long"), F.lit(len(edges) + 1))


def _quantiles(df: DataFrame, column: str, pieces: int, rows: int) -> list[int]:
    """Values that part ``df`` into about equal pieces, judged from a sample.

    Like the samples a range partitioner takes, this one decides only where to cut; results
    do not depend on it.  Its size grows with the number of pieces, not with the rows.
    """
    sampled = min(1.0, SAMPLES_PER_PIECE * pieces / rows)
    seen = df if sampled == 1.0 else df.sample(sampled, seed=C.SEED)
    shares = [i / pieces for i in range(1, pieces)]
    accuracy = max(10_000, 20 * pieces)
    return seen.agg(F.percentile_approx(column, shares, accuracy)).first()[0] or []


def _distinct_as_double(values: list[int]) -> list[int]:
    """Ascending values whose double images differ: the cell search compares doubles.

    Rounding to double keeps the order, so cells stay in order beyond 2**53 as well.
    """
    return sorted({float(v): v for v in values}.values())


@dataclass(frozen=True)
class FrequentKeys:
    """Keys with more than ``limit`` rows each, and the rows they hold together."""

    rows: int
    limit: int
    keys: list[tuple] = field(default_factory=list)
    held: int = 0


def frequent_keys(df: DataFrame, keys: list[str], floor: int, factor: float) -> FrequentKeys:
    """Keys with more rows than ``max(floor, factor * rows / partitions)``.

    A table no larger than that needs no look.  Otherwise one pass counts rows per key
    (key columns only, combined map-side), and only the counts above the limit, of which
    there are at most ``partitions / factor``, reach the driver.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.count()
    limit = max(floor, ceil(factor * rows / partitions))
    if rows <= limit:
        return FrequentKeys(rows, limit)
    found = (
        df.where(all_present(keys))
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("rows"))
        .where(F.col("rows") > limit)
        .collect()
    )
    return FrequentKeys(
        rows, limit, [tuple(r[k] for k in keys) for r in found], sum(r["rows"] for r in found)
    )


def find_cuts(
    df: DataFrame,
    floor: int = LONG_SERIES_FLOOR,
    factor: float = LONG_SERIES_FACTOR,
) -> SeriesCuts:
    """Find the series that are too long for a task and where to cut them."""
    found = frequent_keys(df, C.SERIES_KEYS, floor, factor)
    rows, limit, long, long_count = found.rows, found.limit, found.keys, found.held
    if not long:
        return SeriesCuts(rows, limit)
    pieces = ceil(long_count / limit)
    long_rows = SeriesCuts(rows, limit, long).only_long(df)
    marks = _quantiles(long_rows, "start_time", pieces, long_count)
    tied = sorted({a for a, b in pairwise(marks) if a == b and float(a) < float(a + 1)})
    tied_ids = []
    if tied:
        tied_rows = long_rows.where(F.col("start_time").isin(tied))
        tied_ids = _quantiles(tied_rows, "row_id", pieces, long_count)
    return SeriesCuts(
        rows, limit, long, sorted(set(marks)), tied, _distinct_as_double(tied_ids)
    )


def _neighbour_rows(
    df: DataFrame, cuts: SeriesCuts, carried: list[str], back: int, ahead: int
) -> DataFrame:
    """Copies of the rows just before and just after every chunk of a long series.

    Only each chunk's first ``ahead`` and last ``back`` rows are looked at; Spark keeps
    them with a group limit before the shuffle.
    """
    columns = [*C.SERIES_ORDER, *[c for c in carried if c not in C.SERIES_ORDER]]
    long_rows = cuts.tag(cuts.only_long(df.select(*C.SERIES_KEYS, *columns)))
    rows = long_rows.select(*C.SERIES_KEYS, CHUNK, F.struct(*columns).alias("row"))
    order = [F.col(f"row.{c}").asc_nulls_last() for c in C.SERIES_ORDER]
    backwards = [F.col(f"row.{c}").desc_nulls_first() for c in C.SERIES_ORDER]
    inside = W.partitionBy(*C.SERIES_KEYS, CHUNK)

    def end_rows(direction: list[Column], keep: int, first: bool) -> DataFrame:
        place = F.row_number().over(inside.orderBy(*direction))
        return (
            rows.withColumn("place", place)
            .where(F.col("place") <= keep)
            .withColumn("opens", (F.col("place") == 1) & F.lit(first))
            .withColumn("closes", (F.col("place") == 1) & ~F.lit(first))
        )

    ends = (
        end_rows(order, max(ahead, 1), True)
        .unionByName(end_rows(backwards, max(back, 1), False))
        .groupBy(*C.SERIES_KEYS, CHUNK, *[F.col(f"row.{c}").alias(c) for c in C.SERIES_ORDER])
        .agg(
            F.any_value("row").alias("row"),
            F.bool_or("opens").alias("opens"),
            F.bool_or("closes").alias("closes"),
        )
    )
    along = series_window()
    nothing = F.array().cast(T.ArrayType(ends.schema["row"].dataType))
    before = F.collect_list("row").over(along.rowsBetween(-back, -1)) if back else nothing
    after = F.collect_list("row").over(along.rowsBetween(1, ahead)) if ahead else nothing
    return (
        ends.withColumns({"before": before, "after": after})
        .where(F.col("opens") | F.col("closes"))
        .select(
            *C.SERIES_KEYS,
            CHUNK,
            F.explode(
                F.concat(
                    F.when(F.col("opens"), F.col("before")).otherwise(nothing),
                    F.when(F.col("closes"), F.col("after")).otherwise(nothing),
                )
            ).alias("row"),
        )
        .select(*C.SERIES_KEYS, CHUNK, "row.*")
    )


def with_series_columns(
    df: DataFrame,
    build: Callable[[WindowSpec], dict[str, Column]],
    carried: list[str],
    back: int,
    ahead: int,
    cuts: SeriesCuts | None = None,
) -> DataFrame:
    """Add window columns computed per series; keeps the chunk number as ``chunk``.

    ``build`` receives the window specification and returns the columns to add.  ``back``
    and ``ahead`` say how many rows its frames reach, ``carried`` which columns they read.
    Rows without a full series key are left out: they belong to no series.
    """
    df = with_series_key(df)
    cuts = find_cuts(df) if cuts is None else cuts
    tagged = cuts.tag(df)
    if not cuts:
        return tagged.withColumns(build(series_window()))
    copies = _neighbour_rows(df, cuts, carried, back, ahead)
    return (
        tagged.withColumn("is_copy", F.lit(False))
        .unionByName(copies.withColumn("is_copy", F.lit(True)), allowMissingColumns=True)
        .withColumns(build(series_window(CHUNK)))
        .where(~F.col("is_copy"))
        .drop("is_copy")
    )
