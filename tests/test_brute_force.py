"""Random tables with gaps, ties and missing values against plain Python."""

import random
import statistics
from collections import defaultdict

import pytest

from headroom import contracts as C
from headroom.operators import features as fe
from headroom.operators import policy
from headroom.operators.context import events_context
from headroom.operators.series import SeriesCuts, find_cuts

USAGE = (
    "collection_id long, instance_index long, start_time long, row_id long, "
    "avg_cpu double, max_cpu double, avg_memory double"
)


def usage_rows(seed, n=400):
    rng = random.Random(seed)
    value = lambda: None if rng.random() < 0.1 else round(rng.random(), 3)
    rows = []
    for i in range(n):
        key = (1, 0) if rng.random() < 0.4 else (rng.randrange(2, 9), rng.randrange(2))
        rows.append((*key, rng.randrange(60), i, value(), value(), value()))
    rng.shuffle(rows)
    return rows


def expected_features(rows):
    series = defaultdict(list)
    for row in rows:
        series[row[:2]].append(row)
    out = {}
    for members in series.values():
        members.sort(key=lambda r: (r[2], r[3]))
        for i, row in enumerate(members):
            earlier = lambda k, field: members[i - k][field] if i >= k else None  # noqa: B023, E731
            window = [r[4] for r in members[max(0, i - 6) : i] if r[4] is not None]
            out[row[3]] = (
                earlier(1, 4), earlier(2, 4), earlier(3, 4), earlier(1, 5), earlier(1, 6),
                statistics.fmean(window) if window else None,
                statistics.stdev(window) if len(window) > 1 else None,
                members[i + 1][4] if i + 1 < len(members) else None,
            )
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("cut", [False, True])
def test_series_features(spark, seed, cut):
    rows = usage_rows(seed)
    df = spark.createDataFrame(rows, USAGE).repartition(6)
    cuts = find_cuts(df, floor=30, factor=0.01) if cut else SeriesCuts(0, 0)
    names = [*C.LAG_FEATURES, "avg_cpu_roll_mean6", "avg_cpu_roll_std6", C.TARGET]
    got = {r["row_id"]: tuple(r[n] for n in names) for r in fe.add_series_features(df, cuts).collect()}
    want = expected_features(rows)
    assert got.keys() == want.keys()
    for row_id, values in want.items():
        assert got[row_id] == pytest.approx(values, abs=1e-9), row_id


EVENTS = (
    "collection_id long, instance_index long, time long, type long, row_id long, priority long, "
    "scheduling_class long, resource_request_cpu double, resource_request_memory double"
)


@pytest.mark.parametrize("seed", [4, 5])
def test_context(spark, seed):
    rng = random.Random(seed)
    maybe = lambda v: None if rng.random() < 0.15 else v
    rows = [
        (rng.randrange(5), rng.randrange(2), maybe(rng.randrange(4)), maybe(rng.randrange(3)), i, maybe(i), i % 4, maybe(i / 7), 0.5)
        for i in range(150)
    ]
    best = {}
    for row in rows:
        time, kind, row_id = row[2], row[3], row[4]
        rank = (kind == 1, time is None, time if time is not None else 0, row_id)
        if row[:2] not in best or rank > best[row[:2]][0]:
            best[row[:2]] = (rank, row[5:])
    got = {
        (r["collection_id"], r["instance_index"]): tuple(r[c] for c in C.CONTEXT_COLUMNS)
        for r in events_context(spark.createDataFrame(rows, EVENTS).repartition(4)).collect()
    }
    assert got == {key: payload for key, (_, payload) in best.items()}


PRED = "model string, actual_cpu double, predicted_cpu double, resource_request_cpu double"


@pytest.mark.parametrize("seed", [6, 7])
def test_policy_grid(spark, seed):
    rng = random.Random(seed)
    request = lambda: rng.choice([None, 0.0, -1.0, 0.2, 0.5, 1.0])
    rows = [(rng.choice("ab"), rng.random(), rng.random(), request()) for _ in range(120)]
    want = {}
    for model in "ab":
        mine = [r for r in rows if r[0] == model]
        for tau in C.THRESHOLDS:
            pairs = []
            for _, actual, predicted, asked in mine:
                capacity = 1.0 if asked is None or asked <= 0 else asked
                pairs.append((actual, predicted * 1.1 if predicted > tau * capacity else capacity))
            surplus = sum(s - a for a, s in pairs if s > a)
            want[model, tau] = (
                sum(a > s for a, s in pairs) / len(pairs),
                surplus / sum(a for a, _ in pairs),
            )
    grid = policy.policy_grid(spark.createDataFrame(rows, PRED).repartition(5))
    got = {(r["model"], r["threshold"]): tuple(r)[2:] for r in grid.collect()}
    assert got.keys() == want.keys()
    for key, values in want.items():
        assert got[key] == pytest.approx(values), key
