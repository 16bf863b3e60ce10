"""Column expressions: missing values, arrays, calendar, time zones."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from headroom.functions import columns as col
from headroom.operators import features as fe
from headroom.plans import catalog
from tests.conftest import SF_SMALL

HOUR = 3_600_000_000


def test_arrays_of_any_length(spark):
    df = spark.createDataFrame(
        [(1, [i / 10 for i in range(11)], [0.9 + i / 100 for i in range(9)]), (2, [0.1] * 3, [0.2] * 3), (3, [], []), (4, None, None)],
        "row_id long, cpu_usage_distribution array<double>, tail_cpu_usage_distribution array<double>",
    )
    got = {r["row_id"]: (r["cpu_p90"], r["cpu_p95"]) for r in fe.add_cpu_percentiles(df).collect()}
    assert got == {1: (0.9, pytest.approx(0.94)), 2: (None, None), 3: (None, None), 4: (None, None)}


def test_missing_tail_column(spark):
    df = spark.createDataFrame([([0.5] * 11,)], "cpu_usage_distribution array<double>")
    assert tuple(fe.add_cpu_percentiles(df).select("cpu_p90", "cpu_p95").first()) == (0.5, None)


def calendar(spark, offsets, **kw):
    df = spark.createDataFrame([(o,) for o in offsets], "start_time long")
    return [(r["hour_of_day"], r["day_of_week"]) for r in fe.add_calendar(df, **kw).collect()]


def test_epoch_is_a_tuesday_evening_in_new_york(spark):
    assert calendar(spark, [0]) == [(20, 1)]


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Kolkata", "UTC"])
def test_calendar_equals_the_timestamp_functions(spark, zone):
    hours = spark.range(-3000, 9000, 7).select((F.col("id") * HOUR + F.col("id")).alias("start_time"))
    ntz = F.convert_timezone(F.lit("UTC"), F.lit(zone), col.trace_timestamp("start_time"))
    both = fe.add_calendar(hours, zone).select(
        (F.col("hour_of_day") == F.hour(ntz)).alias("hour"),
        (F.col("day_of_week") == F.weekday(ntz)).alias("day"),
        (col.local_time("start_time", zone) == ntz).alias("time"),
    )
    assert both.distinct().collect() == [(True, True, True)]


def test_clock_changes(spark):
    # 2019-03-10 06:30 UTC is 01:30 EST; an hour later the clock shows 03:30
    assert [h for h, _ in calendar(spark, [6 * HOUR + HOUR // 2, 7 * HOUR + HOUR // 2], epoch="2019-03-10")] == [1, 3]
    # 2019-11-03 05:30 UTC is 01:30 EDT; an hour later the clock shows 01:30 again
    assert [h for h, _ in calendar(spark, [5 * HOUR + HOUR // 2, 6 * HOUR + HOUR // 2], epoch="2019-11-03")] == [1, 1]


@pytest.mark.parametrize("zone", ["Asia/Tokyo", "America/New_York"])
def test_results_do_not_depend_on_the_session_zone(spark, zone):
    names = ["temporal_features", "events_context", "usage_scan_7d"]

    def run():
        return [sorted(map(repr, contract.queries()[n](spark, SF_SMALL).collect())) for n in names]

    before = run()
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        assert run() == before
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_results_do_not_depend_on_the_partition_count(spark):
    def run():
        return sorted(map(repr, catalog.features_clean(spark, SF_SMALL).collect()))

    before = run()
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert run() == before
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, 0.5)], "k long, v double")
    assert sorted(map(tuple, col.nan_to_null(df).collect())) == [(1, None), (2, 0.5)]


def test_incomplete_rows_are_dropped(spark):
    df = spark.createDataFrame([(1, 0.5), (2, None), (3, float("nan"))], "priority long, avg_cpu_target double")
    assert [r["priority"] for r in fe.drop_incomplete(df).collect()] == [1]


def test_schema_tolerance(spark):
    df = spark.createDataFrame([(1, 2)], "a long, b long")
    assert col.select_present(df, ["b", "c"]).columns == ["b"]
    assert col.missing(df, ["b", "d", "c"]) == ["c", "d"]
    assert col.with_default(df, "c").schema["c"].dataType.simpleString() == "double"
    assert col.with_default(df, "a").columns == df.columns


@pytest.mark.parametrize("p, label", [(0.0004, "p < 0.001"), (0.001, "p = 0.001"), (0.25, "p = 0.250"), (None, None)])
def test_p_labels(spark, p, label):
    assert spark.range(1).select(col.p_value_label(F.lit(p).cast("double"))).first()[0] == label


def test_drop_report_of_an_empty_table(spark):
    df = spark.createDataFrame([], "priority long, avg_cpu_target double")
    assert tuple(fe.null_drop_report(df).first()) == (0, 0, 0, 0.0)
