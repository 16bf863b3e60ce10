"""Total order over a whole table without sending the table through one task.

Two tools cover every global-order operator:

* ``keys_at`` finds the exact sort key of the k-th row by narrowing a histogram.  No row
  is shuffled; splits, folds and row caps then become plain filters on that key.
* ``range_number`` tells each row its range from its sort key alone; ``global_lag_totals`` compares
  neighbours inside each range and stitches the ranges together through one summary row per range.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from headroom import contracts as C
from headroom.functions.columns import precedes_or_is

HISTOGRAM_BITS = 12
FINAL_SORT_ROWS = 50_000


@dataclass(frozen=True)
class Extent:
    rows: int
    low: int | None
    high: int | None


def extent(df: DataFrame, column: str) -> Extent:
    """Row count and value range in one pass."""
    row = df.agg(
        F.count(F.lit(1)).alias("rows"), F.min(column).alias("low"), F.max(column).alias("high")
    ).first()
    return Extent(row["rows"], row["low"], row["high"])


def _histogram(df: DataFrame, column: str, low: int, high: int) -> list:
    """Counts of ``column`` in at most 2**12 + 1 order-preserving cells, in order."""
    shift = max(0, (high - low).bit_length() - HISTOGRAM_BITS)
    return sorted(
        df.where(F.col(column).between(low, high))
        .groupBy(F.shiftright(column, shift).alias("cell"))
        .agg(F.count(F.lit(1)).alias("rows"), F.min(column).alias("low"), F.max(column).alias("high"))
        .collect(),
        key=lambda cell: cell["cell"],
    )


def _locate(cells: list, position: int) -> tuple:
    for cell in cells:
        if position <= cell["rows"]:
            return cell, position
        position -= cell["rows"]
    raise ValueError("position lies beyond the last row")


def keys_at(
    df: DataFrame, order: list[str], positions: list[int], size: Extent | None = None
) -> dict[int, tuple]:
    """Sort keys of the rows at the given 1-based positions of ``df`` ordered by ``order``.

    ``order`` must be non-null long columns that identify a row.  Each pass counts rows in
    a few thousand cells of the leading column and keeps the one cell that holds the wanted
    row, so the driver sees cell counts only.  Narrowing repeats (and moves to the next
    column once a single value is left) until few enough rows remain for a bounded sort.
    Passes after the first read only row groups that overlap the cell.
    """
    size = size or extent(df, order[0])
    for position in positions:
        if not 1 <= position <= size.rows:
            raise ValueError(f"position {position} outside 1..{size.rows}")
    if not positions:
        return {}
    # The first pass is the only full one; all positions share it.
    cells = _histogram(df, order[0], size.low, size.high)
    wanted = {}
    for position in sorted(set(positions)):
        cell, inner = _locate(cells, position)
        wanted[position] = _narrow(df, order, cell, inner, {})
    ranges = list(dict.fromkeys(ranges for ranges, _ in wanted.values()))
    rows = _rows_at(df, order, ranges, [place for _, place in wanted.values()])
    return {
        position: rows[ranges.index(found), place]
        for position, (found, place) in wanted.items()
    }


def _narrow(
    df: DataFrame, order: list[str], cell, position: int, fixed: dict[str, tuple]
) -> tuple[tuple, int]:
    """Column ranges that hold the wanted row and few others, and its place among them."""
    column, rest = order[0], order[1:]
    while cell["rows"] > FINAL_SORT_ROWS and cell["low"] < cell["high"]:
        cell, position = _locate(
            _histogram(df, column, cell["low"], cell["high"]), position
        )
    ranges = fixed | {column: (cell["low"], cell["high"])}
    if cell["rows"] <= FINAL_SORT_ROWS or not rest:
        return tuple((c, low, high) for c, (low, high) in ranges.items()), position
    tied = df.where(F.col(column) == cell["low"])
    size = extent(tied, rest[0])
    inner, position = _locate(_histogram(tied, rest[0], size.low, size.high), position)
    return _narrow(tied, rest, inner, position, ranges)


def _rows_at(
    df: DataFrame, order: list[str], ranges: list[tuple], places: list[int]
) -> dict[tuple[int, int], tuple]:
    """Rows at the wanted places of each range (the ranges are disjoint), in one job."""
    inside = [
        reduce(and_, [F.col(c).between(low, high) for c, low, high in bounds])
        for bounds in ranges
    ]
    number = F.coalesce(*[F.when(test, i) for i, test in enumerate(inside)])
    within = W.partitionBy("range").orderBy(*order)
    found = (
        df.where(reduce(or_, inside))
        .select(*order, number.alias("range"))
        .withColumn("place", F.row_number().over(within))
        .where(F.col("place").isin(sorted(set(places))))
        .collect()
    )
    return {(r["range"], r["place"]): tuple(r[c] for c in order) for r in found}


def first_rows(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The ``n`` first rows by ``order`` as a filter (reproducible row cap).

    A plain ``limit`` would funnel every partition's first ``n`` rows into one task.
    """
    size = extent(df, order[0])
    if n >= size.rows:
        return df
    if n <= 0:
        return df.where(F.lit(False))
    return df.where(precedes_or_is(order, keys_at(df, order, [n], size)[n]))


@dataclass(frozen=True)
class TimeSplit:
    """Chronological split; ``in_train`` is the row test that both sides come from."""

    train: DataFrame
    test: DataFrame
    in_train: Column
    train_rows: int
    test_rows: int


def time_split(
    df: DataFrame, share: float = C.TRAIN_SHARE, order: list[str] = C.TIME_ORDER
) -> TimeSplit:
    """First ``int(share * n)`` rows by time for training, the others for testing."""
    size = extent(df, order[0])
    cutoff = int(size.rows * share)
    if cutoff == 0:
        in_train = F.lit(False)
    elif cutoff == size.rows:
        in_train = F.lit(True)
    else:
        in_train = precedes_or_is(order, keys_at(df, order, [cutoff], size)[cutoff])
    return TimeSplit(
        df.where(in_train), df.where(~in_train), in_train, cutoff, size.rows - cutoff
    )


@dataclass(frozen=True)
class Fold:
    """One expanding fold: train on everything before the test block."""

    train: Column
    test: Column
    train_rows: int
    test_rows: int


def expanding_folds(
    df: DataFrame, folds: int = C.FOLDS, order: list[str] = C.TIME_ORDER
) -> list[Fold]:
    """Time folds whose test blocks are the last ``folds`` blocks of ``n // (folds + 1)``."""
    size = extent(df, order[0])
    block = size.rows // (folds + 1)
    if block == 0:
        raise ValueError(f"{folds} folds need at least {folds + 1} rows, got {size.rows}")
    ends = [size.rows - block * k for k in range(folds, 0, -1)]
    keys = keys_at(df, order, ends, size)
    upto = [precedes_or_is(order, keys[end]) for end in ends] + [F.lit(True)]
    return [
        Fold(train=upto[i], test=~upto[i] & upto[i + 1], train_rows=ends[i], test_rows=block)
        for i in range(folds)
    ]


def label_folds(df: DataFrame, folds: list[Fold]) -> DataFrame:
    """Add ``fold1``, ``fold2``, … holding 'train', 'test' or NULL (not yet seen)."""
    return df.withColumns(
        {
            f"fold{i}": F.when(fold.train, "train").when(fold.test, "test")
            for i, fold in enumerate(folds, start=1)
        }
    )


SAMPLED_KEYS = 20  # for each range
MOST_RANGES = 10_000


def range_number(df: DataFrame, order: list[str], ranges: int | None = None) -> Column:
    """Number of the range that a row belongs to, computed from its sort key alone.

    Ranges are consecutive in the order and of about the same size: their ends are quantiles of a sample of whole
    sort keys, chosen by hash, so equal leading values spread over several ranges.  A row's range is found by
    bisection among the ends, which are a constant of the plan.
    """
    if ranges is None:
        ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(1, min(ranges, MOST_RANGES))
    rows = df.count()
    share = min(1.0, ranges * SAMPLED_KEYS / max(rows, 1))
    picked = F.shiftrightunsigned(F.xxhash64(F.lit("range"), *order), 33) < F.lit(int(share * 2**31))
    sample = sorted(tuple(r) for r in df.where(picked).select(*order).collect())
    ends = sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)}) if sample else []
    if not ends:
        return F.lit(0)
    kinds = ", ".join(f"{c}: {df.schema[c].dataType.simpleString()}" for c in order)
    known = F.from_json(F.lit(json.dumps([dict(zip(order, end)) for end in ends])), f"array<struct<{kinds}>>")
    key = F.struct(*order)

    def halve(at: Column, _: Column) -> Column:
        middle = F.floor((at["low"] + at["high"]) / 2).cast("int")
        beyond = F.coalesce(F.get(known, middle) <= key, F.lit(False))
        return F.struct(
            F.when(beyond, middle + 1).otherwise(at["low"]).alias("low"),
            F.when(beyond, at["high"]).otherwise(middle).alias("high"),
        )

    steps = F.sequence(F.lit(1), F.lit(len(ends).bit_length() + 1))
    start = F.struct(F.lit(0).alias("low"), F.lit(len(ends)).alias("high"))
    return F.aggregate(steps, start, halve, lambda at: at["low"])


def global_lag_totals(
    df: DataFrame, value: str, totals: dict[str, Column], order: list[str] = C.TIME_ORDER
) -> DataFrame:
    """Sum expressions over (``current``, ``previous``) pairs of the whole table's order.

    ``totals`` maps a name to an expression of the columns ``current`` and ``previous``;
    the first row of the table is paired with itself.
    """
    narrow = df.select(*order, F.col(value).alias("current"))
    ranges = narrow.withColumn("range_id", range_number(narrow, order))
    # the only exchange of rows: the window and the aggregate both need them by range
    inside = W.partitionBy("range_id").orderBy(*order)
    key = F.struct(*order)
    summaries = (
        ranges.withColumn("previous", F.lag("current").over(inside))
        .groupBy("range_id")
        .agg(
            *[
                F.sum(F.when(F.col("previous").isNotNull(), expr)).alias(name)
                for name, expr in totals.items()
            ],
            F.min_by("current", key).alias("head"),
            F.max_by("current", key).alias("tail"),
        )
    )
    # One row per range from here on, so an unpartitioned window is bounded by the
    # number of ranges.
    across = W.orderBy("range_id")
    heads = summaries.withColumns(
        {
            "current": F.col("head"),
            "previous": F.coalesce(F.lag("tail").over(across), F.col("head")),
        }
    )
    return heads.agg(
        *[
            F.sum(F.coalesce(F.col(name), F.lit(0)) + expr).alias(name)
            for name, expr in totals.items()
        ]
    )
