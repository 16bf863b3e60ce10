"""Workload forecasting and capacity policy on Spark DataFrames."""

from headroom.contracts import FEATURES, THRESHOLDS
from headroom.operators.chartdata import (
    accuracy_chart,
    busiest_series,
    scatter_sample,
    series_trace,
    top_features,
    tradeoff_curves,
    trend_line,
)
from headroom.operators.context import events_context, join_context
from headroom.operators.features import build_features, featured_usage, null_drop_report
from headroom.operators.forecast import VARIANTS, grid_search, train_variants
from headroom.operators.ordering import expanding_folds, first_rows, time_split
from headroom.operators.policy import (
    accuracy_violation_study,
    policy_grid,
    policy_with_baseline,
    reactive_global,
    reactive_per_series,
    simulate_policy,
)
from headroom.plans.jobs import Sources, run_study

__all__ = [
    "FEATURES",
    "THRESHOLDS",
    "VARIANTS",
    "Sources",
    "accuracy_chart",
    "accuracy_violation_study",
    "build_features",
    "busiest_series",
    "events_context",
    "expanding_folds",
    "featured_usage",
    "first_rows",
    "grid_search",
    "join_context",
    "null_drop_report",
    "policy_grid",
    "policy_with_baseline",
    "reactive_global",
    "reactive_per_series",
    "run_study",
    "scatter_sample",
    "series_trace",
    "simulate_policy",
    "time_split",
    "top_features",
    "train_variants",
    "tradeoff_curves",
    "trend_line",
]
