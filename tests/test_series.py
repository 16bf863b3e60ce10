"""Window features: hand-written frames, and cut series against uncut ones."""

import random

import pytest
from pyspark.sql import functions as F

from headroom import contracts as C
from headroom.operators import features as fe
from headroom.operators.series import CHUNK, SeriesCuts, find_cuts

SCHEMA = (
    "collection_id long, instance_index long, start_time long, row_id long, "
    "avg_cpu double, max_cpu double, avg_memory double"
)
WHOLE = SeriesCuts(0, 0)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def series(spark, values, key=(1, 0)):
    return frame(
        spark, [(*key, t, t, v, None if v is None else v * 2, v) for t, v in enumerate(values)]
    )


def column(df, name):
    return [r[name] for r in df.orderBy("collection_id", "instance_index", "start_time", "row_id").collect()]


def test_short_series(spark):
    out = fe.add_series_features(series(spark, [1.0, 2.0, 3.0, 4.0]), WHOLE)
    assert column(out, "avg_cpu_lag3") == [None, None, None, 1.0]
    assert column(out, "max_cpu_lag1") == [None, 2.0, 4.0, 6.0]
    assert column(out, "avg_memory_lag1") == [None, 1.0, 2.0, 3.0]
    assert column(out, "avg_cpu_roll_std6")[:2] == [None, None]
    assert column(out, "avg_cpu_target") == [2.0, 3.0, 4.0, None]


def test_doubling_series_matches_known_statistics(spark):
    out = fe.add_rolling(series(spark, [float(2**i) for i in range(8)]), WHOLE)
    mean = column(out, "avg_cpu_roll_mean6")
    deviation = column(out, "avg_cpu_roll_std6")
    assert mean[0] is None
    assert mean[1:] == pytest.approx([1, 1.5, 2.3333, 3.75, 6.2, 10.5, 21.0], abs=1e-4)
    assert deviation[:2] == [None, None]
    assert deviation[2:] == pytest.approx([0.707, 1.528, 3.096, 6.099, 11.862, 23.723], abs=1e-3)


def test_null_gap_is_passed_on_by_lag_and_skipped_by_mean(spark):
    out = fe.add_series_features(series(spark, [1.0, None, 3.0, 5.0]), WHOLE)
    assert column(out, "avg_cpu_lag1") == [None, 1.0, None, 3.0]
    assert column(out, "avg_cpu_roll_mean6") == [None, 1.0, 1.0, 2.0]


def test_rows_without_series_key_are_left_out(spark):
    df = frame(spark, [(1, None, 0, 0, 1.0, 1.0, 1.0), (1, 0, 0, 1, 1.0, 1.0, 1.0)])
    assert [r["row_id"] for r in fe.add_lags(df).collect()] == [1]


def test_equal_times_follow_row_id(spark):
    df = frame(spark, [(1, 0, 5, i, float(i), 0.0, 0.0) for i in (2, 0, 1)])
    assert column(fe.add_lags(df, WHOLE), "avg_cpu_lag1") == [None, 0.0, 1.0]


def _mixed(spark, tied):
    """One series with half of all rows, many short ones, optionally one tied time."""
    rng = random.Random(7)
    rows = []
    for i in range(600):
        t = 500 if tied and i % 3 else None if i % 50 == 0 else rng.randrange(1000)
        rows.append((9, 1, t, i, rng.random(), rng.random(), rng.random()))
    for i in range(600, 1200):
        rows.append((i % 60, 0, rng.randrange(1000), i, rng.random(), rng.random(), rng.random()))
    return frame(spark, rows).repartition(5)


@pytest.mark.parametrize("tied", [False, True])
@pytest.mark.parametrize("floor", [3, 40, 200])
def test_cut_series_equal_uncut_ones(spark, tied, floor):
    df = _mixed(spark, tied).persist()
    # factor close to zero lets the floor alone decide, so tiny tables get cut as well
    cuts = find_cuts(df, floor=floor, factor=0.01)
    assert cuts and (9, 1) in cuts.long
    if floor == 40:
        assert cuts.tied_times == ([500] if tied else [])
    names = ["row_id", *C.LAG_FEATURES, "avg_cpu_roll_mean6", "avg_cpu_roll_std6", C.TARGET]
    cut = fe.add_series_features(df, cuts)
    whole = fe.add_series_features(df, WHOLE)
    assert cut.where(F.col(CHUNK) > 0).select(CHUNK).distinct().count() > 1
    assert sorted(map(tuple, cut.select(names).collect())) == sorted(
        map(tuple, whole.select(names).collect())
    )
    df.unpersist()


def test_chunks_stay_bounded(spark):
    df = _mixed(spark, tied=True)
    cuts = find_cuts(df, floor=40, factor=0.01)
    sizes = (
        cuts.tag(df).where(F.col(CHUNK) > 0).groupBy(*C.SERIES_KEYS, CHUNK).count().agg(F.max("count"))
    )
    assert sizes.first()[0] <= 3 * cuts.limit


def test_balanced_tables_are_not_cut(spark):
    df = frame(spark, [(i % 50, 0, i, i, 1.0, 1.0, 1.0) for i in range(500)])
    cuts = find_cuts(df)
    assert not cuts and cuts.rows == 500


def test_empty_table(spark):
    df = frame(spark, [])
    assert not find_cuts(df)
    assert fe.add_series_features(df).count() == 0


def test_window_features_take_one_shuffle_and_one_window(spark, capsys):
    fe.add_series_features(series(spark, [1.0, 2.0]), WHOLE).explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange") == 1
    assert plan.count("Window [") + plan.count("+- Window") >= 1
    assert plan.count("Window ") == 1


def test_cuts_from_a_sample_give_the_same_features(spark, monkeypatch):
    monkeypatch.setattr("headroom.operators.series.SAMPLES_PER_PIECE", 5)
    df = _mixed(spark, tied=True).persist()
    cuts = find_cuts(df, floor=40, factor=0.01)
    assert cuts
    names = ["row_id", *C.LAG_FEATURES, "avg_cpu_roll_mean6", "avg_cpu_roll_std6", C.TARGET]
    cut, whole = (fe.add_series_features(df, c).select(names).collect() for c in (cuts, WHOLE))
    assert sorted(map(tuple, cut)) == sorted(map(tuple, whole))
    df.unpersist()


def test_long_series_without_times_stays_whole(spark):
    rows = [(1, 0, None, i, float(i), 0.0, 0.0) for i in range(60)]
    df = frame(spark, rows)
    cuts = find_cuts(df, floor=20, factor=0.01)
    assert cuts.long == [(1, 0)] and not cuts.times
    got = {r["row_id"]: r["avg_cpu_lag1"] for r in fe.add_lags(df, cuts).collect()}
    assert got == {i: float(i - 1) if i else None for i in range(60)}
