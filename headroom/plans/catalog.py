"""Named queries over the test tables; each runs on whole tables.

Steps exchange stored tables: the feature table and the prediction table are built once
per session and folder, then read by the queries that come after them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from headroom import contracts as C
from headroom.functions import columns as col
from headroom.functions import statistics as st
from headroom.operators import chartdata, forecast, ordering, policy, trees
from headroom.operators import features as fe
from headroom.operators.context import events_context, join_context
from headroom.operators.ordering import TimeSplit
from headroom.operators.series import find_cuts
from headroom.plans import jobs
from headroom.plans.stand_ins import REFERENCE_MODEL, stand_in_predictions
from headroom.sources import adapters, sinks, tables
from headroom.sources.staging import fresh_path

CAPPED_ROWS = 1000
# arrays compare by element: as many as a curve has
CURVES = {"cpu_usage_distribution": 11, "tail_cpu_usage_distribution": 9}
IDENTITY = ["row_id", *C.SERIES_KEYS, "start_time"]

_STAGED: dict[tuple[str, str, str], str] = {}


def _staged(
    spark: SparkSession,
    sf_dir: str,
    name: str,
    build: Callable[[SparkSession, str], DataFrame],
    partition_by: list[str] | None = None,
) -> DataFrame:
    """A table built once per session and folder, and again if somebody has removed it since."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STAGED or not sinks.is_complete(spark, _STAGED[key]):
        path = fresh_path(spark, name)
        sinks.write_parquet(build(spark, sf_dir), path, partition_by)
        _STAGED[key] = path
    return spark.read.parquet(_STAGED[key])


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    """Sums and means agree between engines only up to the order of additions."""
    return df.withColumns({n: F.round(n, 6) for n in names})


def _as_double(df: DataFrame, *names: str) -> DataFrame:
    """Integer columns with gaps, which clients represent differently, as doubles."""
    return df.withColumns({n: F.col(n).cast("double") for n in names})


# --- Tables that queries start from ----------------------------------------------------


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return col.nan_to_null(adapters.usage(spark, sf_dir))


def usage_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return col.nan_to_null(adapters.usage_rows(spark, sf_dir))


def instance_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return col.nan_to_null(
        tables.flatten_instance_events(adapters.instance_events_source(spark, sf_dir))
    )


def featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Series lengths do not depend on the arrays, so counting them skips their join.
    cuts = find_cuts(usage_rows(spark, sf_dir))
    return fe.featured_usage(usage(spark, sf_dir), instance_events(spark, sf_dir), cuts)


def features_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fe.drop_incomplete(featured(spark, sf_dir))


def stored_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _staged(spark, sf_dir, "features", lambda *at: sinks.by_time(features_clean(*at)))


def split(spark: SparkSession, sf_dir: str) -> TimeSplit:
    return ordering.time_split(stored_features(spark, sf_dir))


def baseline_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stand_in_predictions(split(spark, sf_dir))


def stored_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _staged(spark, sf_dir, "predictions", baseline_predictions, ["model"])


def one_model(spark: SparkSession, sf_dir: str, model: str = REFERENCE_MODEL) -> DataFrame:
    return stored_predictions(spark, sf_dir).where(F.col("model") == model)


# --- Sources and projections -----------------------------------------------------------


def usage_scan_7d(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.extract_usage(adapters.usage_source(spark, sf_dir), row_cap=None)
    elements = {f"{c}_{i}": F.get(c, F.lit(i)) for c, n in CURVES.items() for i in range(n)}
    scalars = rows.withColumns(elements).drop(*CURVES)
    return _as_double(scalars, "alloc_collection_id", "alloc_instance_index")


def usage_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.extract_usage(adapters.usage_source(spark, sf_dir), row_cap=CAPPED_ROWS)
    return rows.select(*IDENTITY, "avg_cpu")


def events_for_seen_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = tables.extract_usage(adapters.usage_source(spark, sf_dir), row_cap=None)
    source = adapters.instance_events_source(spark, sf_dir)
    return _as_double(tables.extract_instance_events(source, seen), "alloc_collection_id")


def machine_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.extract_machine_events(adapters.machine_events_source(spark, sf_dir))


def schema_tolerant_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usage_rows(spark, sf_dir)
    wanted = ["row_id", *C.META, "priority", "cpu_p90", "resource_request_cpu"]
    return col.with_default(col.select_present(rows, wanted), "cpu_p95")


# --- Features --------------------------------------------------------------------------


def lag_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fe.add_lags(usage_rows(spark, sf_dir)).select(*IDENTITY, *C.LAG_FEATURES)


def rolling_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["avg_cpu_roll_mean6", "avg_cpu_roll_std6"]
    return _rounded(fe.add_rolling(usage_rows(spark, sf_dir)).select(*IDENTITY, *names), *names)


def next_window_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fe.add_target(usage_rows(spark, sf_dir)).select(*IDENTITY, C.TARGET)


def cpu_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fe.add_cpu_percentiles(usage(spark, sf_dir)).select(*IDENTITY, "cpu_p90", "cpu_p95")


def temporal_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fe.add_calendar(usage_rows(spark, sf_dir)).select(
        *IDENTITY, "hour_of_day", "day_of_week"
    )


def context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_context(instance_events(spark, sf_dir))


def context_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usage_rows(spark, sf_dir).withColumn("priority", F.col("machine_id"))
    joined = join_context(rows, context(spark, sf_dir))
    added = ["priority", "priority_evt", *[c for c in C.CONTEXT_COLUMNS if c != "priority"]]
    return _as_double(joined.select(*IDENTITY, *added), "priority_evt", "scheduling_class")


def features_rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(features_clean(spark, sf_dir), "avg_cpu_roll_mean6", "avg_cpu_roll_std6")


def null_drop_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(fe.null_drop_report(featured(spark, sf_dir)), "dropped_pct")


def null_drop_missing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report over usage of which every tenth row has lost a series key."""
    kept = F.when(F.col("row_id") % 10 != 0, F.col("instance_index"))
    rows = usage(spark, sf_dir).withColumn("instance_index", kept)
    whole = fe.featured_usage(rows, instance_events(spark, sf_dir))
    return _rounded(fe.null_drop_report(whole), "dropped_pct")


# --- Order over the whole table --------------------------------------------------------


def time_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored_features(spark, sf_dir)
    side = F.when(ordering.time_split(rows).in_train, "train").otherwise("test")
    return rows.select(*IDENTITY, side.alias("side"))


def expanding_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored_features(spark, sf_dir)
    labelled = ordering.label_folds(rows, ordering.expanding_folds(rows))
    return labelled.select(*IDENTITY, "fold1", "fold2", "fold3")


# --- Accuracy and policy ---------------------------------------------------------------


def predictions_rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(baseline_predictions(spark, sf_dir), "predicted_cpu")


def regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics(spark, sf_dir), "r2", "mae", "rmse")


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.regression_metrics(stored_predictions(spark, sf_dir))


def capacity_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    request = F.col("resource_request_cpu")
    return instance_events(spark, sf_dir).select(
        "row_id", request, col.usable_capacity(request).alias("capacity")
    )


OUTCOME = ["sla_violation_rate", "over_provision_cost"]


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.policy_grid(stored_predictions(spark, sf_dir))


def sla_policy_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(grid(spark, sf_dir), *OUTCOME)


def reactive_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(policy.reactive_global(one_model(spark, sf_dir)), *OUTCOME)


def reactive_per_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(policy.reactive_per_series(one_model(spark, sf_dir)), *OUTCOME)


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    predictions = stored_predictions(spark, sf_dir)
    return policy.policy_with_baseline(predictions, one_model(spark, sf_dir))


def policy_with_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(results(spark, sf_dir), *OUTCOME)


# --- Accuracy against violations -------------------------------------------------------


def study(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return policy.accuracy_violation_study(results(spark, sf_dir), metrics(spark, sf_dir))


def study_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The study reads the grid only: the reactive baseline has no accuracy and drops out.
    return policy.study_rows(grid(spark, sf_dir), metrics(spark, sf_dir))


def accuracy_vs_violation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = policy.study_rows(results(spark, sf_dir), metrics(spark, sf_dir))
    return _rounded(rows, "r2", *OUTCOME)


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.correlation_summary(study_rows(spark, sf_dir), "r2", "sla_violation_rate", per_model=True)


def pearson_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = _summary(spark, sf_dir).select("pearson_r", "spearman_r", "n")
    return _rounded(summary, "pearson_r", "spearman_r")


def correlation_pvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = _summary(spark, sf_dir).select(
        "pearson_p",
        "spearman_p",
        col.p_value_label("pearson_p").alias("pearson_label"),
        col.p_value_label("spearman_p").alias("spearman_label"),
    )
    return _rounded(summary, "pearson_p", "spearman_p")


RANKED_FEATURES = ["priority", "hour_of_day", "avg_cpu_lag1", "avg_cpu_roll_mean6"]


def feature_rank_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pearson and Spearman of features with the target over all clean rows, ties included."""
    rows = stored_features(spark, sf_dir)
    parts = [
        st.correlation_summary(rows, f, C.TARGET).select(F.lit(f).alias("feature"), "pearson_r", "spearman_r", "n")
        for f in RANKED_FEATURES
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return _rounded(out, "pearson_r", "spearman_r")


def accuracy_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = chartdata.accuracy_chart(study_rows(spark, sf_dir))
    return _rounded(points, "r2", "sla_violation_rate", "slope", "intercept", "pearson_r")


def trend_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(chartdata.trend_line(study_rows(spark, sf_dir)), "x", "y")


def squared_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    r2: Column = st.squared_correlation("actual_cpu", "predicted_cpu")
    by_model = stored_predictions(spark, sf_dir).groupBy("model")
    return _rounded(by_model.agg(r2.alias("r2")), "r2")


def tradeoff_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Rounded before ranking, so that equal rates tie in every engine.
    return chartdata.tradeoff_curves(policy_with_baseline(spark, sf_dir))


# --- Series views ----------------------------------------------------------------------


def busiest_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chartdata.busiest_series(usage_rows(spark, sf_dir))


def series_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    trace = chartdata.series_trace(one_model(spark, sf_dir))
    return _rounded(trace, "t_min")


SMALL_SAMPLE = 1000


def scatter_sample_1000(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = chartdata.scatter_sample(one_model(spark, sf_dir), SMALL_SAMPLE)
    return _rounded(chosen, "r2", "lim_max")


def scatter_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(chartdata.scatter_sample(one_model(spark, sf_dir)), "r2", "lim_max")


# --- Stored tables ---------------------------------------------------------------------


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = sinks.write_csv(grid(spark, sf_dir), fresh_path(spark, "policy_results"))
    return _rounded(tables.read_csv(spark, path, C.POLICY_RESULTS), *OUTCOME)


def json_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = study(spark, sf_dir)[1]
    path = sinks.write_json(summary, fresh_path(spark, "study_summary"))
    stored = tables.read_json(spark, path, C.STUDY_SUMMARY)
    return _rounded(stored, *C.STUDY_SUMMARY.fieldNames())


def parquet_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "predictions_by_model")
    sinks.write_predictions(stored_predictions(spark, sf_dir), path)
    wanted = ["lag1", "peak", "never_trained"]
    return _rounded(tables.read_predictions(spark, path, wanted), "predicted_cpu")


# --- Forests ---------------------------------------------------------------------------


# The declared variants and grid, unless a caller bounds them (``forecast.light()``, a smaller grid).

_FITS: dict[tuple[str, str], forecast.Fits] = {}


def _fits(spark: SparkSession, sf_dir: str) -> forecast.Fits:
    """Where the forests of a folder's features are kept: each is grown by the first query that needs it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    return _FITS.setdefault(key, forecast.Fits(fresh_path(spark, "fits")))


def _trained(
    spark: SparkSession, sf_dir: str, variants: Iterable[forecast.Variant], grid: dict[str, list]
) -> forecast.Training:
    rows = stored_features(spark, sf_dir)
    return forecast.train_variants(rows, variants, grid, fits=_fits(spark, sf_dir))


def forest_variants(
    spark: SparkSession,
    sf_dir: str,
    variants: Iterable[forecast.Variant] = tuple(forecast.VARIANTS),
    grid: dict[str, list] = forecast.PARAM_GRID,
) -> DataFrame:
    training = _trained(spark, sf_dir, variants, grid)
    return forecast.metric_rows(training.predictions, training.fitted)


#: Variants whose setting is given, not searched.
GIVEN = tuple(v for v in forecast.VARIANTS if not v.search)


def forest_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest_variants(spark, sf_dir, GIVEN)


def forest_prediction_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is exact of the predictions: everything but the predicted value, which lies between the target's extremes."""
    rows = stored_features(spark, sf_dir)
    low, high = rows.agg(F.min(C.TARGET), F.max(C.TARGET)).first()
    out = _trained(spark, sf_dir, GIVEN, forecast.PARAM_GRID).predictions
    return out.withColumn("in_range", F.col("predicted_cpu").between(low, high)).drop("predicted_cpu")


def forest_importance_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is exact of the importances: models, features, and their sum."""
    rows = _trained(spark, sf_dir, GIVEN, forecast.PARAM_GRID).importances
    total = F.round(F.sum("importance").over(W.partitionBy("model")), 6)
    return rows.select("model", "feature", (F.col("importance") >= 0).alias("not_negative"), total.alias("total"))


TREE_DEPTH = 2


def regression_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of one tree of depth 2 over the train rows, each counted once."""
    train = split(spark, sf_dir).train
    stop = trees.Stop(1, TREE_DEPTH)
    grown = trees.load(_fits(spark, sf_dir).trees(train, C.FEATURES, stop, None), 1)
    share = trees.importance(grown, len(C.FEATURES), stop)
    nodes, rows, open_ = grown[0], [], [(0, "root")]
    for at, place in open_:
        feature, left = int(nodes["feature"][at]), int(nodes["left"][at])
        inner = feature >= 0
        rows.append((place, C.FEATURES[feature] if inner else None, float(nodes["threshold"][at]) if inner else None, float(nodes["value"][at]), int(nodes["rows"][at]), float(share[feature]) if inner else None))
        open_ += [(left, f"{place}.left"), (left + 1, f"{place}.right")] if inner else []
    made = spark.createDataFrame(rows, "node string, feature string, threshold double, value double, n_rows long, importance double")
    return _rounded(made, "threshold", "value", "importance")


def forest_importances(
    spark: SparkSession,
    sf_dir: str,
    variants: Iterable[forecast.Variant] = tuple(forecast.VARIANTS),
    grid: dict[str, list] = forecast.PARAM_GRID,
) -> DataFrame:
    return chartdata.top_features(_trained(spark, sf_dir, variants, grid).importances, model=None)


def forest_grid_search(
    spark: SparkSession, sf_dir: str, grid: dict[str, list] = forecast.PARAM_GRID
) -> DataFrame:
    train = split(spark, sf_dir).train
    found = forecast.grid_search(train, C.FEATURES, grid, fits=_fits(spark, sf_dir))
    rows = [
        (p["n_estimators"], p["max_depth"], p["min_samples_split"], score, p == found.best)
        for p, score in found.scores
    ]
    return spark.createDataFrame(
        rows,
        "n_estimators int, max_depth int, min_samples_split int, mean_r2 double, chosen boolean",
    )


def full_study(
    spark: SparkSession,
    sf_dir: str,
    variants: Iterable[forecast.Variant] = tuple(forecast.VARIANTS),
    grid: dict[str, list] = forecast.PARAM_GRID,
) -> DataFrame:
    root = fresh_path(spark, "study")
    sources = jobs.Sources(
        adapters.usage_source(spark, sf_dir),
        adapters.instance_events_source(spark, sf_dir),
        adapters.machine_events_source(spark, sf_dir),
    )
    jobs.run_study(spark, root, sources, variants=variants, grid=grid, row_cap=None)
    return tables.read_csv(spark, f"{root}/policy_results", C.POLICY_RESULTS)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "usage_scan_7d": usage_scan_7d,
    "usage_capped": usage_capped,
    "events_for_seen_collections": events_for_seen_collections,
    "machine_capacity": machine_capacity,
    "schema_tolerant_select": schema_tolerant_select,
    "lag_features": lag_features,
    "rolling_features": rolling_features,
    "next_window_target": next_window_target,
    "cpu_percentiles": cpu_percentiles,
    "temporal_features": temporal_features,
    "events_context": context,
    "context_join": context_join,
    "features_clean": features_rounded,
    "null_drop_report": null_drop_report,
    "null_drop_missing_keys": null_drop_missing_keys,
    "time_split": time_split,
    "expanding_folds": expanding_folds,
    "baseline_predictions": predictions_rounded,
    "regression_metrics": regression_metrics,
    "capacity_defaults": capacity_defaults,
    "sla_policy_grid": sla_policy_grid,
    "reactive_global": reactive_global,
    "reactive_per_series": reactive_per_series,
    "policy_with_baseline": policy_with_baseline,
    "accuracy_vs_violation": accuracy_vs_violation,
    "pearson_spearman": pearson_spearman,
    "correlation_pvalues": correlation_pvalues,
    "accuracy_chart": accuracy_chart,
    "trend_line": trend_line,
    "squared_correlation": squared_correlation,
    "tradeoff_curves": tradeoff_curves,
    "busiest_series": busiest_series,
    "series_trace": series_trace,
    "scatter_sample": scatter_sample,
    "scatter_sample_1000": scatter_sample_1000,
    "feature_rank_correlation": feature_rank_correlation,
    "csv_round_trip": csv_round_trip,
    "json_summary": json_summary,
    "parquet_round_trip": parquet_round_trip,
    "forest_given": forest_given,
    "forest_prediction_rows": forest_prediction_rows,
    "forest_importance_rows": forest_importance_rows,
    "regression_tree": regression_tree,
    "forest_variants": forest_variants,
    "forest_grid_search": forest_grid_search,
    "forest_importances": forest_importances,
    "full_study": full_study,
}
