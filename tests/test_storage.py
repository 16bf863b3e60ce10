"""Sources, sinks, staged tables and the end-to-end jobs."""

import json

import pytest
from pyspark.sql import functions as F

from headroom import contracts as C
from headroom.operators import forecast
from headroom.plans import catalog, jobs
from headroom.sources import adapters, sinks, staging, tables
from tests.conftest import SF_SMALL


def test_nested_columns_and_period_are_pushed_into_the_scan(spark, tmp_path):
    path = str(tmp_path / "usage")
    adapters.usage_source(spark, SF_SMALL).write.parquet(path)
    source = tables.read_parquet(spark, path, C.USAGE_SOURCE)
    rows = tables.extract_usage(source, row_cap=None).select("row_id", "avg_cpu")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(start_time,604800000000)" in plan
    schema = plan[plan.index("ReadSchema") :]
    assert "cpus" in schema and "memory" not in schema and "maximum_usage" not in schema
    assert rows.count() == 248


def test_period_includes_both_ends(spark):
    source = adapters.usage_source(spark, SF_SMALL).limit(4)
    edges = [0, C.SEVEN_DAYS_US, -1, C.SEVEN_DAYS_US + 1]
    times = F.element_at(F.array(*[F.lit(t).cast("long") for t in edges]), (F.col("place") % 4 + 1).cast("int"))
    rows = source.withColumn("place", F.monotonically_increasing_id()).withColumn("start_time", times).drop("place")
    got = {r["start_time"] for r in tables.extract_usage(rows, row_cap=None).collect()}
    assert got == {0, C.SEVEN_DAYS_US}


def test_row_cap_is_exact_and_earliest_first(spark):
    source = adapters.usage_source(spark, SF_SMALL)
    full = tables.extract_usage(source, row_cap=None).orderBy(*C.SERIES_ORDER).limit(100)
    capped = tables.extract_usage(source, row_cap=100)
    assert sorted(r["row_id"] for r in capped.collect()) == sorted(r["row_id"] for r in full.collect())
    assert tables.extract_usage(source).count() == 248


def test_events_of_unseen_collections_are_left_out(spark):
    source = adapters.instance_events_source(spark, SF_SMALL)
    usage = spark.createDataFrame([(3,), (3,), (None,)], "collection_id long")
    events = tables.extract_instance_events(source, usage)
    assert events.columns == C.INSTANCE_EVENTS.fieldNames()
    assert events.count() == source.where("collection_id = 3").count() > 0


def test_row_cap_counts_rows_without_series_key(spark):
    source = adapters.usage_source(spark, SF_SMALL)
    source = source.withColumn("collection_id", F.when(F.col("row_id") % 2 == 0, F.col("collection_id")))
    source = source.withColumn("start_time", F.lit(5).cast("long"))
    assert tables.extract_usage(source, row_cap=100).count() == 100


def test_rows_without_id_are_numbered_once(spark, tmp_path):
    path = str(tmp_path / "usage")
    adapters.usage_source(spark, SF_SMALL).drop("row_id").repartition(3).write.parquet(path)
    rows = tables.extract_usage(spark.read.parquet(path), row_cap=100)
    assert rows.count() == rows.select("row_id").distinct().count() == 100
    events = adapters.instance_events_source(spark, SF_SMALL).drop("row_id")
    numbered = tables.extract_instance_events(events, rows)
    assert numbered.columns == C.INSTANCE_EVENTS.fieldNames()
    assert numbered.count() == numbered.select("row_id").distinct().count() > 0


def test_frequent_collections_are_not_shuffled(spark):
    keys = [(7 if i % 3 else i % 40, i) for i in range(300)] + [(None, 900), (8, 901)]
    source = spark.createDataFrame(keys, "collection_id long, row_id long")
    source = source.withColumn("resource_request", F.struct(F.lit(0.1).alias("cpus"), F.lit(0.2).alias("memory")))
    for wanted in ([7, 3, 3, 8, None], [3, 8], [99]):
        usage = spark.createDataFrame([(w,) for w in wanted], "collection_id long")
        got = tables.extract_instance_events(source, usage, floor=50, factor=0.01)
        assert sorted(r["row_id"] for r in got.collect()) == [i for c, i in keys if c is not None and c in wanted]
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "Union" in plan and "LeftAnti" in plan


def test_extracted_schemas(spark):
    usage = tables.extract_usage(adapters.usage_source(spark, SF_SMALL))
    assert dict(usage.dtypes) == {f.name: f.dataType.simpleString() for f in C.USAGE}
    machines = tables.extract_machine_events(adapters.machine_events_source(spark, SF_SMALL))
    assert dict(machines.dtypes) == {f.name: f.dataType.simpleString() for f in C.MACHINE_EVENTS}
    features = catalog.stored_features(spark, SF_SMALL)
    assert dict(features.dtypes) == {f.name: f.dataType.simpleString() for f in C.FEATURE_TABLE}


def test_csv_keeps_quoted_parameters_and_nulls(spark, tmp_path):
    params = json.dumps({"n_estimators": 10, "max_depth": None})
    df = spark.createDataFrame([("m", 0.1, None, 1.0 / 3, params)], C.MODEL_METRICS)
    sinks.write_csv(df, str(tmp_path / "t"))
    assert tables.read_csv(spark, str(tmp_path / "t"), C.MODEL_METRICS).collect() == df.collect()


def test_json_keeps_null_fields(spark, tmp_path):
    df = spark.createDataFrame([(0.5, None, 0.25, 0.75)], C.STUDY_SUMMARY)
    path = sinks.write_json(df, str(tmp_path / "t"))
    assert '"pearson_p":null' in spark.read.text(path).first()[0]
    assert tables.read_json(spark, path, C.STUDY_SUMMARY).collect() == df.collect()
    assert json.loads(sinks.as_json(df).first()[0])["pearson_p"] is None


def test_predictions_are_read_by_partition(spark, tmp_path):
    rows = [(m, 1, 1, 0, 1, 0.1, 0.2, 0.3, i) for i, m in enumerate(["a", "b", "c"])]
    path = sinks.write_predictions(spark.createDataFrame(rows, C.PREDICTIONS), str(tmp_path / "p"))
    got = tables.read_predictions(spark, path, ["a", "c", "absent"])
    assert {r["model"] for r in got.collect()} == {"a", "c"}
    assert "PartitionFilters: [isnotnull(model" in got._jdf.queryExecution().executedPlan().toString() or (
        "PartitionFilters: [model" in got._jdf.queryExecution().executedPlan().toString()
    )
    # a later write replaces the models that it has, and no other
    again = [("a", 1, 1, 0, 1, 0.1, 0.9, 0.3, i) for i in (7, 8)]
    sinks.write_predictions(spark.createDataFrame(again, C.PREDICTIONS), path)
    left = tables.read_predictions(spark, path).collect()
    assert sorted((r["model"], r["row_id"]) for r in left) == [("a", 7), ("a", 8), ("b", 1), ("c", 2)]


class _Session:
    """Just the settings that the shared folder is read from."""

    def __init__(self, folder, master="spark://host:7077"):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = type("Context", (), {"master": master, "applicationId": "app"})


def test_staged_tables_live_in_the_configured_folder(spark, tmp_path, monkeypatch):
    assert staging.shared_folder(_Session("hdfs://shared/")) == "hdfs://shared"
    with pytest.raises(ValueError):
        staging.shared_folder(_Session(None))
    monkeypatch.setattr(staging, "shared_folder", lambda _: str(tmp_path))
    staged = staging.stage(spark.range(5), "numbers")
    assert staged.count() == 5
    assert all(str(tmp_path) in f for f in staged.inputFiles())


@pytest.fixture(scope="module")
def study_root(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("study"))
    sources = jobs.Sources(
        adapters.usage_source(spark, SF_SMALL),
        adapters.instance_events_source(spark, SF_SMALL),
        adapters.machine_events_source(spark, SF_SMALL),
    )
    jobs.run_study(spark, root, sources, variants=forecast.light(trees=2, depth=2))
    return root


def test_full_study_writes_every_table(spark, study_root):
    results = tables.read_csv(spark, f"{study_root}/policy_results", C.POLICY_RESULTS)
    assert results.count() == 40
    assert tables.read_csv(spark, f"{study_root}/study_rows", C.STUDY_ROWS).count() == 7
    assert tables.read_json(spark, f"{study_root}/study_summary", C.STUDY_SUMMARY).count() == 1
    assert tables.read_csv(spark, f"{study_root}/feature_importances", C.FEATURE_IMPORTANCES).count() == 84
    assert spark.read.parquet(f"{study_root}/charts/accuracy_line").count() == 100
    assert spark.read.parquet(f"{study_root}/charts/top_features").count() == 15
    assert spark.read.parquet(f"{study_root}/machine_events").where("type = 2").count() == 0


def test_missing_variants_are_skipped(spark, study_root, tmp_path):
    kept = tables.read_predictions(spark, f"{study_root}/predictions", ["lag_only", "shallow_d3"])
    sinks.write_predictions(kept, str(tmp_path / "predictions"))
    metrics = tables.read_csv(spark, f"{study_root}/model_metrics", C.MODEL_METRICS)
    sinks.write_csv(metrics, str(tmp_path / "model_metrics"))
    jobs.run_study(spark, str(tmp_path), steps=["simulate"])
    results = tables.read_csv(spark, str(tmp_path / "policy_results"), C.POLICY_RESULTS)
    # without the best model's predictions there is no reactive baseline either
    assert {r["model"] for r in results.select("model").distinct().collect()} == {"lag_only", "shallow_d3"}


def test_steps_can_be_chosen(spark, tmp_path):
    with pytest.raises(ValueError):
        jobs.run_study(spark, str(tmp_path), steps=["draw"])
    with pytest.raises(ValueError):
        jobs.run_study(spark, str(tmp_path), steps=["extract"])


def test_absent_input_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        jobs.run_study(spark, str(tmp_path), steps=["features"])
