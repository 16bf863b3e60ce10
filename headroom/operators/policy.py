"""Provisioning policies over predictions: violation rate and over-provisioning cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headroom import contracts as C
from headroom.functions.columns import usable_capacity, with_default
from headroom.functions.statistics import correlation_summary
from headroom.operators.ordering import global_lag_totals
from headroom.operators.series import SeriesCuts, with_series_columns


def provisioned(
    predicted: Column, capacity: Column, threshold: Column, margin: float = C.SAFETY_MARGIN
) -> Column:
    """Prediction with a margin when it exceeds the trigger level, else current capacity."""
    scale_out = predicted > threshold * capacity
    return F.when(scale_out, predicted * margin).otherwise(capacity)


def outcome_totals(actual: Column, supply: Column) -> dict[str, Column]:
    """Per-row summands of the two outcome measures."""
    return {
        "rows": F.lit(1).cast("long"),
        "violations": (actual > supply).cast("long"),
        "surplus_rows": (supply > actual).cast("long"),
        "surplus": F.greatest(supply - actual, F.lit(0.0)),
        "demand": actual,
    }


def outcome_rates() -> dict[str, Column]:
    """The two outcome measures from summed ``outcome_totals``.

    Surplus is relative to the demand of all rows, not only of those with a surplus.  Zero
    demand gives NULL; no surplus row at all gives 0.
    """
    cost = F.try_divide(F.col("surplus"), F.col("demand"))
    return {
        "sla_violation_rate": F.col("violations") / F.col("rows"),
        "over_provision_cost": F.when(F.col("surplus_rows") == 0, 0.0).otherwise(cost),
    }


def _rate_columns() -> list[Column]:
    return [rate.alias(name) for name, rate in outcome_rates().items()]


def policy_grid(
    predictions: DataFrame,
    thresholds: tuple[float, ...] = C.THRESHOLDS,
    margin: float = C.SAFETY_MARGIN,
) -> DataFrame:
    """Outcome of the predictive policy for every model and threshold, in one scan.

    Each row is evaluated against all thresholds and partially aggregated where it is
    read; what gets shuffled is one row per task, model and threshold.
    """
    rows = with_default(predictions, "resource_request_cpu").select(
        "model",
        F.col("actual_cpu").alias("actual"),
        F.col("predicted_cpu").alias("predicted"),
        usable_capacity("resource_request_cpu").alias("capacity"),
        F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold"),
    )
    supply = provisioned(F.col("predicted"), F.col("capacity"), F.col("threshold"), margin)
    totals = outcome_totals(F.col("actual"), supply)
    return (
        rows.groupBy("model", "threshold")
        .agg(*[F.sum(expr).alias(name) for name, expr in totals.items()])
        .select("model", "threshold", *_rate_columns())
    )


def simulate_policy(
    predictions: DataFrame, threshold: float, margin: float = C.SAFETY_MARGIN
) -> DataFrame:
    """``policy_grid`` at a single threshold."""
    return policy_grid(predictions, (threshold,), margin)


def reactive_global(predictions: DataFrame) -> DataFrame:
    """Each row provisioned with the actual value of the row before it in time order.

    The order runs over the whole test set, so the row before usually belongs to another
    instance; ``reactive_per_series`` is the per-instance form.  One row.
    """
    totals = outcome_totals(F.col("current"), F.col("previous"))
    return global_lag_totals(predictions, "actual_cpu", totals).select(*_rate_columns())


def reactive_per_series(predictions: DataFrame, cuts: SeriesCuts | None = None) -> DataFrame:
    """Each row provisioned with the previous actual value of its own series.  One row."""
    narrow = predictions.select(*C.SERIES_KEYS, *C.SERIES_ORDER, "actual_cpu")
    paired = with_series_columns(
        narrow,
        lambda w: {"previous": F.lag("actual_cpu", 1).over(w)},
        ["actual_cpu"],
        1,
        0,
        cuts,
    )
    supply = F.coalesce("previous", "actual_cpu")
    totals = outcome_totals(F.col("actual_cpu"), supply)
    return paired.agg(*[F.sum(expr).alias(name) for name, expr in totals.items()]).select(
        *_rate_columns()
    )


def for_thresholds(
    baseline: DataFrame,
    thresholds: tuple[float, ...] = C.THRESHOLDS,
    name: str = C.BASELINE_MODEL,
) -> DataFrame:
    """Repeat a threshold-independent outcome for every threshold of the grid."""
    return baseline.select(
        F.lit(name).alias("model"),
        F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold"),
        "sla_violation_rate",
        "over_provision_cost",
    )


def policy_with_baseline(
    predictions: DataFrame,
    baseline_rows: DataFrame,
    thresholds: tuple[float, ...] = C.THRESHOLDS,
    margin: float = C.SAFETY_MARGIN,
) -> DataFrame:
    """The policy grid plus the reactive baseline computed from ``baseline_rows``."""
    grid = policy_grid(predictions, thresholds, margin)
    return grid.unionByName(for_thresholds(reactive_global(baseline_rows), thresholds))


def study_rows(
    results: DataFrame, metrics: DataFrame, threshold: float = C.STUDY_THRESHOLD
) -> DataFrame:
    """Accuracy next to policy outcome at one threshold; models without r2 drop out.

    Both sides have one row per model.
    """
    at_threshold = results.where(F.col("threshold") == threshold)
    joined = at_threshold.join(metrics.select("model", "r2"), "model", "left")
    return joined.where(F.col("r2").isNotNull()).select(
        "model", "r2", "sla_violation_rate", "over_provision_cost"
    )


def accuracy_violation_study(
    results: DataFrame, metrics: DataFrame, threshold: float = C.STUDY_THRESHOLD
) -> tuple[DataFrame, DataFrame]:
    """Study rows per model, and the one-row correlation summary of r2 and violations."""
    rows = study_rows(results, metrics, threshold)
    summary = correlation_summary(rows, "r2", "sla_violation_rate", per_model=True)
    return rows, summary.select(*C.STUDY_SUMMARY.fieldNames())
