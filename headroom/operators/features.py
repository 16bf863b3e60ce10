"""Per-series features: percentiles, calendar, lags, rolling statistics, context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from headroom import contracts as C
from headroom.functions.columns import (
    day_of_week,
    element_or_null,
    hour_of_day,
    is_filled,
    local_micros,
    present,
    select_present,
    with_default,
)
from headroom.operators.context import events_context, join_context
from headroom.operators.series import (
    CHUNK,
    SeriesCuts,
    find_cuts,
    with_series_columns,
    without_series_key,
)

_MEASURES = ["avg_cpu", "max_cpu", "avg_memory"]


def add_cpu_percentiles(df: DataFrame) -> DataFrame:
    """``cpu_p90`` and ``cpu_p95`` out of the distribution arrays; NULL when too short."""
    df = df.withColumn("cpu_p90", element_or_null("cpu_usage_distribution", C.P90_INDEX))
    if "tail_cpu_usage_distribution" not in df.columns:
        return with_default(df, "cpu_p95")
    return df.withColumn("cpu_p95", element_or_null("tail_cpu_usage_distribution", C.P95_INDEX))


def add_calendar(df: DataFrame, zone: str = C.CELL_ZONE, epoch: str = C.TRACE_EPOCH) -> DataFrame:
    """``hour_of_day`` and ``day_of_week`` (Monday = 0) on the cell's wall clock."""
    local = local_micros("start_time", zone, epoch)
    return df.withColumns({"hour_of_day": hour_of_day(local), "day_of_week": day_of_week(local)})


def lag_columns(w: WindowSpec) -> dict[str, Column]:
    """Values of earlier rows of the series; rows are counted, not time steps."""
    cpu = {f"avg_cpu_lag{k}": F.lag("avg_cpu", k).over(w) for k in (1, 2, 3)}
    return cpu | {
        "max_cpu_lag1": F.lag("max_cpu", 1).over(w),
        "avg_memory_lag1": F.lag("avg_memory", 1).over(w),
    }


def rolling_columns(w: WindowSpec) -> dict[str, Column]:
    """Mean and sample deviation of the rows before the current one, partial at the start."""
    before = w.rowsBetween(-C.ROLLING_ROWS, -1)
    return {
        "avg_cpu_roll_mean6": F.avg("avg_cpu").over(before),
        "avg_cpu_roll_std6": F.stddev_samp("avg_cpu").over(before),
    }


def target_column(w: WindowSpec) -> dict[str, Column]:
    return {C.TARGET: F.lead("avg_cpu", 1).over(w)}


def add_lags(df: DataFrame, cuts: SeriesCuts | None = None) -> DataFrame:
    return with_series_columns(df, lag_columns, _MEASURES, 3, 0, cuts).drop(CHUNK)


def add_rolling(df: DataFrame, cuts: SeriesCuts | None = None) -> DataFrame:
    return with_series_columns(df, rolling_columns, ["avg_cpu"], C.ROLLING_ROWS, 0, cuts).drop(CHUNK)


def add_target(df: DataFrame, cuts: SeriesCuts | None = None) -> DataFrame:
    return with_series_columns(df, target_column, ["avg_cpu"], 0, 1, cuts).drop(CHUNK)


def add_series_features(df: DataFrame, cuts: SeriesCuts | None = None) -> DataFrame:
    """Lags, rolling statistics and target in one shuffle and one sort."""

    def build(w: WindowSpec) -> dict[str, Column]:
        return lag_columns(w) | rolling_columns(w) | target_column(w)

    return with_series_columns(df, build, _MEASURES, C.ROLLING_ROWS, 1, cuts)


def select_features(df: DataFrame) -> DataFrame:
    """Meta, feature and target columns (those that exist) plus the tie-break."""
    return select_present(df, C.META + C.FEATURES + [C.TARGET, "row_id"])


def model_columns(df: DataFrame) -> list[str]:
    """The columns of ``df`` that a usable row must have filled."""
    return present(df, C.FEATURES + [C.TARGET])


def drop_incomplete(df: DataFrame) -> DataFrame:
    return df.where(is_filled(df, model_columns(df)))


def null_drop_report(featured: DataFrame) -> DataFrame:
    """Rows before and after the cleaning step and the percentage lost, in one pass."""
    kept = F.count_if(is_filled(featured, model_columns(featured)))
    total = F.count(F.lit(1))
    return featured.agg(
        total.alias("rows_before"),
        kept.alias("rows_after"),
        (total - kept).alias("rows_dropped"),
        (F.lit(100.0) * (total - kept) / F.greatest(total, F.lit(1))).alias("dropped_pct"),
    )


def featured_usage(
    usage: DataFrame, events: DataFrame, cuts: SeriesCuts | None = None
) -> DataFrame:
    """All features of all usage rows, incomplete rows included.

    Rows without a full series key belong to no series and have no context: they pass the
    windows by, without features of either, and are found by their filter at the scan.

    Order of steps matters for the shuffle: the percentile arrays shrink to two numbers
    before it, the calendar is derived after it.  The context joins on the partitioning
    that the windows left behind.
    """
    cuts = find_cuts(usage) if cuts is None else cuts
    usage = select_present(
        add_cpu_percentiles(usage), C.META + C.FEATURES + ["row_id"]
    )
    rows = add_series_features(usage, cuts)
    rows = join_context(rows, events_context(events), cuts)
    rows = select_features(add_calendar(rows))
    keyless = add_calendar(without_series_key(usage))
    keyless = keyless.select(*present(keyless, rows.columns))
    return rows.unionByName(keyless, allowMissingColumns=True)


def build_features(
    usage: DataFrame, events: DataFrame, cuts: SeriesCuts | None = None
) -> DataFrame:
    """The model-ready feature table: one row per usage row with nothing missing."""
    return drop_incomplete(featured_usage(usage, events, cuts))
