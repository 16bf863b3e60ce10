"""Latest-event context and its join."""

import pytest
from pyspark.sql import functions as F

from headroom.operators import features as fe
from headroom.operators.context import events_context, join_context
from headroom.operators.joins import split_join
from headroom.operators.series import SeriesCuts, find_cuts
from headroom.plans import catalog
from tests.conftest import SF_SMALL

SCHEMA = (
    "collection_id long, instance_index long, time long, type long, row_id long, priority long, "
    "scheduling_class long, resource_request_cpu double, resource_request_memory double"
)


def event(time, kind, row_id, priority, key=(1, 0)):
    return (*key, time, kind, row_id, priority, 2, 0.5, 0.25)


def winner(spark, *events):
    (row,) = events_context(spark.createDataFrame(list(events), SCHEMA)).collect()
    return row["priority"]


def test_older_schedule_event_beats_newer_other_event(spark):
    assert winner(spark, event(1, 1, 1, 10), event(9, 2, 2, 20)) == 10


def test_latest_schedule_event(spark):
    assert winner(spark, event(1, 1, 1, 10), event(5, 1, 2, 11), event(3, 1, 3, 12)) == 11


def test_falls_back_to_latest_other_event(spark):
    assert winner(spark, event(1, 0, 1, 10), event(9, 2, 2, 20)) == 20


def test_equal_times_go_to_the_highest_row_id(spark):
    assert winner(spark, event(5, 1, 7, 70), event(5, 1, 9, 90), event(5, 1, 8, 80)) == 90


def test_missing_time_counts_as_latest(spark):
    assert winner(spark, event(None, 1, 1, 10), event(99, 1, 2, 20)) == 10


def test_missing_type_is_a_fallback(spark):
    assert winner(spark, event(9, None, 1, 10), event(1, 1, 2, 20)) == 20
    assert winner(spark, event(9, None, 1, 10), event(1, 0, 2, 20)) == 10


def test_missing_payload_is_not_filled_from_older_event(spark):
    assert winner(spark, event(1, 1, 1, 10), event(2, 1, 2, None)) is None


def test_absent_columns_are_tolerated(spark):
    events = spark.createDataFrame([event(1, 0, 1, 10)], SCHEMA).drop("type", "priority")
    assert "priority" not in events_context(events).columns


def test_join_keeps_every_row_and_suffixes_clashes(spark):
    usage = spark.createDataFrame([(1, 0, 5), (2, 0, 6)], "collection_id long, instance_index long, priority long")
    ctx = events_context(spark.createDataFrame([event(1, 1, 1, 10)], SCHEMA))
    got = {r["collection_id"]: (r["priority"], r["priority_evt"]) for r in join_context(usage, ctx).collect()}
    assert got == {1: (5, 10), 2: (6, None)}


@pytest.fixture(scope="module")
def small(spark):
    usage = catalog.usage(spark, SF_SMALL).persist()
    yield usage, catalog.instance_events(spark, SF_SMALL)
    usage.unpersist()


def test_cut_feature_table_equals_uncut_one(spark, small):
    usage, events = small
    cuts = find_cuts(usage, floor=30, factor=0.01)
    assert 0 < len(cuts.long) < 30
    cut = fe.build_features(usage, events, cuts)
    whole = fe.build_features(usage, events, SeriesCuts(0, 0))
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, whole.collect()))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_context_join_reuses_the_window_partitioning(spark, small):
    usage, events = small
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for cuts in (SeriesCuts(0, 0), find_cuts(usage, floor=30, factor=0.01)):
            plan = _plan(fe.featured_usage(usage, events, cuts))
            join = plan[plan.index("SortMergeJoin") :]
            left = join[: join.index("Window [")]
            # nothing between the join and the window below it reshuffles the usage rows
            assert "Exchange" not in left
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_row_count_is_unchanged_by_the_join(spark, small):
    usage, events = small
    assert fe.featured_usage(usage, events).count() == usage.count()


def test_clean_table_has_nothing_missing(spark, small):
    clean = fe.build_features(*small)
    holes = clean.select([F.count_if(F.col(c).isNull()).alias(c) for c in fe.model_columns(clean)])
    assert set(holes.first()) == {0}
    report = fe.null_drop_report(fe.featured_usage(*small)).first()
    assert report["rows_before"] == 1000 and report["rows_after"] == clean.count() == 713


def test_split_join_equals_a_plain_one(spark):
    """Half of the rows have one key; another frequent key has no partner, and so have null keys."""
    left = spark.range(4000).select("id", F.when(F.col("id") % 2 == 0, 1).when(F.col("id") % 3 == 0, 2).when(F.col("id") % 7 == 0, None).otherwise(F.col("id")).alias("k"), F.lit("x").alias("m"))
    right = spark.range(3000).where("id <> 2").select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"), F.lit(None).cast("string").alias("w"))
    plain = left.join(right, ["k"], "left").select("id", "k", "m", "v", "w")
    for floor in (10, 10**6):
        got = split_join(left, right, ["k"], floor=floor, factor=0.5)
        assert sorted(map(tuple, got.select(*plain.columns).collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)


def test_split_join_spreads_a_frequent_key(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        left = spark.range(40_000).select("id", F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("k"))
        right = spark.range(40_000).select(F.col("id").alias("k"), F.lit(5).alias("v"))
        joined = split_join(left, right, ["k"], floor=1000, factor=0.5)
        plan = _plan(joined)
        assert "BroadcastHashJoin" in plan, plan
        assert "SortMergeJoin" in plan, plan
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) < 2 * 40_000 / 8, sizes
        assert joined.where("v = 5").count() == 40_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_context_is_hashed_not_sorted(spark, small):
    plan = _plan(events_context(small[1]))
    assert "SortAggregate" not in plan and plan.count("HashAggregate") == 2


def test_extreme_times_keep_their_order(spark):
    far = 2**63 - 1
    rows = [event(-far, 0, 1, 10), event(far, 0, 2, 20)]
    rows += [event(-far, 0, 3, 30, (2, 0)), event(-far + 1, 0, 0, 40, (2, 0))]
    rows += [event(-far, 1, 2**60 - 1, 50, (3, 0)), event(None, 0, 0, 60, (3, 0))]
    got = {r["collection_id"]: r["priority"] for r in events_context(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: 20, 2: 40, 3: 50}
