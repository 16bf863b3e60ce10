"""The same queries in SQL, for comparison on another engine.

``VIEWS`` are common table expressions that build on each other; ``ORACLE`` prefixes every
query with the ones it needs.
"""

from __future__ import annotations

from headroom import contracts as C
from headroom.operators import trees
from headroom.plans.catalog import CAPPED_ROWS, CURVES, GIVEN, RANKED_FEATURES, SMALL_SAMPLE, TREE_DEPTH

_ORDER = "start_time, collection_id, instance_index, row_id"
_KEEP = "row_id, collection_id, instance_index, start_time"
_CLEAN = " AND ".join(f"{c} IS NOT NULL" for c in [*C.FEATURES, C.TARGET])

VIEWS = {
    "usage_v": """
        SELECT epoch_us(e.ts) - 1704067200000000 AS start_time,
               epoch_us(e.ts) - 1704067200000000 + 300000000 AS end_time,
               e.user_id AS collection_id,
               CAST(e.event_id % 2 AS BIGINT) AS instance_index,
               CAST(e.user_id % 10 AS BIGINT) AS machine_id,
               CAST(NULL AS BIGINT) AS alloc_collection_id,
               CAST(NULL AS BIGINT) AS alloc_instance_index,
               CAST(e.event_id % 2 AS BIGINT) AS collection_type,
               e.value / 500::DOUBLE AS avg_cpu,
               CAST(json_extract_string(e.props, '$.k') AS DOUBLE) / 100::DOUBLE AS avg_memory,
               e.value / 400::DOUBLE AS max_cpu,
               CAST(json_extract_string(e.props, '$.k') AS DOUBLE) / 100::DOUBLE * 1.25::DOUBLE AS max_memory,
               1.0::DOUBLE AS assigned_memory,
               1::DOUBLE + (e.event_id % 5) / 10::DOUBLE AS cycles_per_instruction,
               (e.event_id % 7) / 1000::DOUBLE AS memory_accesses_per_instruction,
               1.0::DOUBLE AS sample_rate,
               m.embedding[1:11] AS cpu_usage_distribution,
               CASE WHEN e.event_id % 7 = 0 THEN m.embedding[12:14] ELSE m.embedding[12:20] END
                   AS tail_cpu_usage_distribution,
               e.event_id AS row_id
        FROM events e LEFT JOIN embeddings m ON m.vec_id = e.event_id % (SELECT count(*) FROM embeddings)""",
    "week_v": f"""
        SELECT * FROM usage_v WHERE start_time BETWEEN 0 AND {C.SEVEN_DAYS_US}""",
    "ievents_v": """
        SELECT epoch_us(o_orderdate) AS time,
               CAST(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 WHEN 'P' THEN 2 END AS BIGINT) AS type,
               o_custkey AS collection_id,
               CAST(o_orderkey % 2 AS BIGINT) AS instance_index,
               CAST(o_custkey % 10 AS BIGINT) AS machine_id,
               CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS priority,
               CAST(o_orderkey % 4 AS BIGINT) AS scheduling_class,
               CAST(o_orderkey % 2 AS BIGINT) AS collection_type,
               CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN 0.0::DOUBLE
                    ELSE o_totalprice / 2000000::DOUBLE END AS resource_request_cpu,
               o_totalprice / 1000000::DOUBLE AS resource_request_memory,
               CAST(NULL AS BIGINT) AS alloc_collection_id,
               o_orderkey AS row_id
        FROM orders""",
    "machine_v": """
        SELECT s_suppkey * 1000000 AS time, s_suppkey AS machine_id,
               CAST(s_suppkey % 3 AS BIGINT) AS type,
               s_acctbal / 10000::DOUBLE AS capacity_cpu, s_acctbal / 20000::DOUBLE AS capacity_memory
        FROM supplier""",
    "context_v": f"""
        SELECT collection_id, instance_index, priority, scheduling_class,
               resource_request_cpu, resource_request_memory
        FROM (SELECT *, row_number() OVER (
                  PARTITION BY collection_id, instance_index
                  ORDER BY coalesce(type = {C.SCHEDULE_TYPE}, false) DESC, (time IS NULL) DESC,
                           time DESC, row_id DESC) AS place
              FROM ievents_v)
        WHERE place = 1""",
    "series_v": """
        SELECT *,
               lag(avg_cpu, 1) OVER w AS avg_cpu_lag1,
               lag(avg_cpu, 2) OVER w AS avg_cpu_lag2,
               lag(avg_cpu, 3) OVER w AS avg_cpu_lag3,
               lag(max_cpu, 1) OVER w AS max_cpu_lag1,
               lag(avg_memory, 1) OVER w AS avg_memory_lag1,
               avg(avg_cpu) OVER before AS avg_cpu_roll_mean6,
               stddev_samp(avg_cpu) OVER before AS avg_cpu_roll_std6,
               lead(avg_cpu, 1) OVER w AS avg_cpu_target,
               CAST(cpu_usage_distribution[10] AS DOUBLE) AS cpu_p90,
               CAST(tail_cpu_usage_distribution[5] AS DOUBLE) AS cpu_p95,
               timezone('America/New_York', timezone('UTC',
                   TIMESTAMP '2019-05-01' + to_microseconds(start_time))) AS local_time
        FROM usage_v
        WINDOW w AS (PARTITION BY collection_id, instance_index ORDER BY start_time, row_id),
               before AS (PARTITION BY collection_id, instance_index ORDER BY start_time, row_id
                          ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)""",
    "featured_v": f"""
        SELECT {", ".join(f"s.{c}" for c in C.META)}, s.row_id,
               {", ".join(f"s.{c}" for c in C.LAG_FEATURES + C.STAT_FEATURES)},
               c.priority, c.scheduling_class, s.collection_type,
               c.resource_request_cpu, c.resource_request_memory,
               CAST(hour(s.local_time) AS INTEGER) AS hour_of_day,
               CAST(isodow(s.local_time) - 1 AS INTEGER) AS day_of_week,
               s.avg_cpu_target
        FROM series_v s LEFT JOIN context_v c
          ON s.collection_id = c.collection_id AND s.instance_index = c.instance_index""",
    "clean_v": f"SELECT * FROM featured_v WHERE {_CLEAN}",
    "ranked_v": f"""
        SELECT *, row_number() OVER (ORDER BY {_ORDER}) AS place, count(*) OVER () AS total
        FROM clean_v""",
    "fit_v": f"""
        SELECT avg(avg_cpu_target) AS mean, regr_slope(avg_cpu_target, avg_cpu_lag1) AS slope,
               regr_intercept(avg_cpu_target, avg_cpu_lag1) AS intercept
        FROM ranked_v WHERE place <= CAST(floor(total * {C.TRAIN_SHARE}::DOUBLE) AS BIGINT)""",
    "pred_v": f"""
        SELECT v.model, start_time, collection_id, instance_index, machine_id,
               avg_cpu_target AS actual_cpu, v.predicted_cpu, resource_request_cpu, row_id
        FROM ranked_v, fit_v, LATERAL (VALUES
               ('lag1', avg_cpu_lag1), ('lag2', avg_cpu_lag2),
               ('mean3', (avg_cpu_lag1 + avg_cpu_lag2 + avg_cpu_lag3) / 3::DOUBLE),
               ('roll6', avg_cpu_roll_mean6), ('peak', max_cpu_lag1), ('train_mean', fit_v.mean),
               ('trend', fit_v.slope * avg_cpu_lag1 + fit_v.intercept)) v(model, predicted_cpu)
        WHERE place > CAST(floor(total * {C.TRAIN_SHARE}::DOUBLE) AS BIGINT)""",
    "metrics_v": """
        SELECT model,
               1 - sum((actual_cpu - predicted_cpu) ** 2)
                   / (var_pop(actual_cpu) * count(actual_cpu)) AS r2,
               avg(abs(actual_cpu - predicted_cpu)) AS mae,
               sqrt(avg((actual_cpu - predicted_cpu) ** 2)) AS rmse
        FROM pred_v GROUP BY model""",
    "supply_v": f"""
        SELECT model, threshold, actual_cpu,
               CASE WHEN predicted_cpu > threshold * capacity
                    THEN predicted_cpu * {C.SAFETY_MARGIN}::DOUBLE ELSE capacity END AS supply
        FROM (SELECT *, CASE WHEN coalesce(resource_request_cpu, 1.0::DOUBLE) <= 0 THEN 1.0::DOUBLE
                             ELSE coalesce(resource_request_cpu, 1.0::DOUBLE) END AS capacity
              FROM pred_v),
             (VALUES {", ".join(f"({t}::DOUBLE)" for t in C.THRESHOLDS)}) grid(threshold)""",
    "grid_v": """
        SELECT model, threshold,
               avg(CAST(actual_cpu > supply AS INTEGER)) AS sla_violation_rate,
               CASE WHEN count(*) FILTER (WHERE supply > actual_cpu) = 0 THEN 0.0::DOUBLE
                    ELSE sum(greatest(supply - actual_cpu, 0.0::DOUBLE)) / sum(actual_cpu)
               END AS over_provision_cost
        FROM supply_v GROUP BY model, threshold""",
    "reactive_v": f"""
        SELECT avg(CAST(actual_cpu > supply AS INTEGER)) AS sla_violation_rate,
               sum(greatest(supply - actual_cpu, 0.0::DOUBLE)) / sum(actual_cpu) AS over_provision_cost
        FROM (SELECT actual_cpu,
                     coalesce(lag(actual_cpu) OVER (ORDER BY {_ORDER}), actual_cpu) AS supply
              FROM pred_v WHERE model = 'lag1')""",
    "results_v": f"""
        SELECT model, threshold, sla_violation_rate, over_provision_cost FROM grid_v
        UNION ALL
        SELECT '{C.BASELINE_MODEL}', threshold, sla_violation_rate, over_provision_cost
        FROM reactive_v, (VALUES {", ".join(f"({t}::DOUBLE)" for t in C.THRESHOLDS)}) grid(threshold)""",
    "study_v": f"""
        SELECT g.model, m.r2, g.sla_violation_rate, g.over_provision_cost
        FROM results_v g LEFT JOIN metrics_v m ON g.model = m.model
        WHERE g.threshold = {C.STUDY_THRESHOLD}::DOUBLE AND m.r2 IS NOT NULL""",
    "corr_v": """
        SELECT corr(r2, sla_violation_rate) AS pearson_r, corr(rx, ry) AS spearman_r, count(*) AS n
        FROM (SELECT *, rank() OVER (ORDER BY r2)
                        + (count(*) OVER (PARTITION BY r2) - 1) / 2::DOUBLE AS rx,
                     rank() OVER (ORDER BY sla_violation_rate)
                        + (count(*) OVER (PARTITION BY sla_violation_rate) - 1) / 2::DOUBLE AS ry
              FROM study_v)""",
    # Seven models, so five degrees of freedom: the t distribution has a closed form.
    "pvalue_v": """
        SELECT *,
               1 - 2 / pi() * (asin(abs(pearson_r)) + abs(pearson_r) * (sqrt(1 - pearson_r ** 2)
                   + 2 / 3::DOUBLE * sqrt(1 - pearson_r ** 2) ** 3)) AS pearson_p,
               1 - 2 / pi() * (asin(abs(spearman_r)) + abs(spearman_r) * (sqrt(1 - spearman_r ** 2)
                   + 2 / 3::DOUBLE * sqrt(1 - spearman_r ** 2) ** 3)) AS spearman_p
        FROM corr_v""",
    "trend_v": """
        SELECT regr_slope(sla_violation_rate, r2) AS slope,
               regr_intercept(sla_violation_rate, r2) AS intercept,
               min(r2) AS x0, max(r2) AS x1
        FROM study_v""",
}

_NEEDS = {
    "week_v": ["usage_v"],
    "context_v": ["ievents_v"],
    "series_v": ["usage_v"],
    "featured_v": ["series_v", "context_v"],
    "clean_v": ["featured_v"],
    "ranked_v": ["clean_v"],
    "fit_v": ["ranked_v"],
    "pred_v": ["ranked_v", "fit_v"],
    "metrics_v": ["pred_v"],
    "supply_v": ["pred_v"],
    "grid_v": ["supply_v"],
    "reactive_v": ["pred_v"],
    "results_v": ["grid_v", "reactive_v"],
    "study_v": ["results_v", "metrics_v"],
    "corr_v": ["study_v"],
    "pvalue_v": ["corr_v"],
    "trend_v": ["study_v"],
}


def _with(views: list[str], select: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        for needed in _NEEDS.get(name, []):
            visit(needed)
        if name not in order:
            order.append(name)

    for view in views:
        visit(view)
    body = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in order)
    return f"WITH {body}\n{select}"


def _round(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


def _label(p: str) -> str:
    return f"CASE WHEN {p} < 0.001::DOUBLE THEN 'p < 0.001' ELSE format('p = {{:.3f}}', {p}) END"


def _fold(k: int) -> str:
    """Role of a row in fold k of 3; test blocks are the last three quarters."""
    begin = f"total - {4 - k} * (total // 4)"
    return (
        f"CASE WHEN place <= {begin} THEN 'train' "
        f"WHEN place <= {begin} + total // 4 THEN 'test' END AS fold{k}"
    )


_SCALARS = [c for c in C.USAGE.fieldNames() if not c.endswith("_distribution")]
_ELEMENTS = [
    f"CAST({c}[{i + 1}] AS DOUBLE) AS {c}_{i}" for c, n in CURVES.items() for i in range(n)
]
_OUTCOME = _round("sla_violation_rate", "over_provision_cost")
_SURPLUS = "sum(greatest(supply - actual_cpu, 0.0::DOUBLE)) / sum(actual_cpu)"



def _sample(n: int) -> str:
    """The ``n`` rows with the smallest MD5 of seed and key."""
    return _with(
        ["pred_v"],
        f"""SELECT actual_cpu AS actual, predicted_cpu AS predicted,
                   round(greatest(max(actual_cpu) OVER (), max(predicted_cpu) OVER ()) * 1.05::DOUBLE, 6) AS lim_max,
                   round(corr(actual_cpu, predicted_cpu) OVER () ** 2, 6) AS r2
            FROM (SELECT * FROM pred_v WHERE model = 'lag1' ORDER BY md5('{C.SEED}:' || row_id) LIMIT {n})""",
    )


ORACLE = {
    "usage_scan_7d": _with(
        ["week_v"],
        f"""SELECT {", ".join(_SCALARS + _ELEMENTS)} FROM (SELECT * REPLACE (
                CAST(alloc_collection_id AS DOUBLE) AS alloc_collection_id,
                CAST(alloc_instance_index AS DOUBLE) AS alloc_instance_index) FROM week_v)""",
    ),
    "usage_capped": _with(
        ["week_v"],
        f"SELECT {_KEEP}, avg_cpu FROM week_v ORDER BY start_time, row_id LIMIT {CAPPED_ROWS}",
    ),
    "events_for_seen_collections": _with(
        ["week_v", "ievents_v"],
        """SELECT * REPLACE (CAST(alloc_collection_id AS DOUBLE) AS alloc_collection_id)
           FROM ievents_v WHERE collection_id IN (SELECT collection_id FROM week_v)""",
    ),
    "machine_capacity": _with(["machine_v"], "SELECT * FROM machine_v WHERE type IN (0, 1)"),
    "schema_tolerant_select": _with(
        ["usage_v"],
        f"SELECT row_id, {', '.join(C.META)}, CAST(NULL AS DOUBLE) AS cpu_p95 FROM usage_v",
    ),
    "lag_features": _with(["series_v"], f"SELECT {_KEEP}, {', '.join(C.LAG_FEATURES)} FROM series_v"),
    "rolling_features": _with(
        ["series_v"],
        f"SELECT {_KEEP}, {_round('avg_cpu_roll_mean6', 'avg_cpu_roll_std6')} FROM series_v",
    ),
    "next_window_target": _with(["series_v"], f"SELECT {_KEEP}, avg_cpu_target FROM series_v"),
    "cpu_percentiles": _with(["series_v"], f"SELECT {_KEEP}, cpu_p90, cpu_p95 FROM series_v"),
    "temporal_features": _with(
        ["featured_v"], f"SELECT {_KEEP}, hour_of_day, day_of_week FROM featured_v"
    ),
    "events_context": _with(["context_v"], "SELECT * FROM context_v"),
    "context_join": _with(
        ["usage_v", "context_v"],
        """SELECT u.row_id, u.collection_id, u.instance_index, u.start_time,
                  u.machine_id AS priority, CAST(c.priority AS DOUBLE) AS priority_evt,
                  CAST(c.scheduling_class AS DOUBLE) AS scheduling_class,
                  c.resource_request_cpu, c.resource_request_memory
           FROM usage_v u LEFT JOIN context_v c
             ON u.collection_id = c.collection_id AND u.instance_index = c.instance_index""",
    ),
    "features_clean": _with(
        ["clean_v"],
        f"""SELECT * REPLACE (round(avg_cpu_roll_mean6, 6) AS avg_cpu_roll_mean6,
                              round(avg_cpu_roll_std6, 6) AS avg_cpu_roll_std6)
            FROM clean_v""",
    ),
    "null_drop_report": _with(
        ["featured_v"],
        f"""SELECT count(*) AS rows_before, count(*) FILTER (WHERE {_CLEAN}) AS rows_after,
                   count(*) - count(*) FILTER (WHERE {_CLEAN}) AS rows_dropped,
                   round(100::DOUBLE * (count(*) - count(*) FILTER (WHERE {_CLEAN}))
                         / greatest(count(*), 1), 6) AS dropped_pct
            FROM featured_v""",
    ),
    "time_split": _with(
        ["ranked_v"],
        f"""SELECT {_KEEP}, CASE WHEN place <= CAST(floor(total * {C.TRAIN_SHARE}::DOUBLE) AS BIGINT)
                                 THEN 'train' ELSE 'test' END AS side
            FROM ranked_v""",
    ),
    "expanding_folds": _with(
        ["ranked_v"], f"SELECT {_KEEP}, {_fold(1)}, {_fold(2)}, {_fold(3)} FROM ranked_v"
    ),
    "baseline_predictions": _with(
        ["pred_v"], "SELECT * REPLACE (round(predicted_cpu, 6) AS predicted_cpu) FROM pred_v"
    ),
    "regression_metrics": _with(
        ["metrics_v"], f"SELECT model, {_round('r2', 'mae', 'rmse')} FROM metrics_v"
    ),
    "capacity_defaults": _with(
        ["ievents_v"],
        """SELECT row_id, resource_request_cpu,
                  CASE WHEN coalesce(resource_request_cpu, 1.0::DOUBLE) <= 0 THEN 1.0::DOUBLE
                       ELSE coalesce(resource_request_cpu, 1.0::DOUBLE) END AS capacity
           FROM ievents_v""",
    ),
    "sla_policy_grid": _with(["grid_v"], f"SELECT model, threshold, {_OUTCOME} FROM grid_v"),
    "reactive_global": _with(["reactive_v"], f"SELECT {_OUTCOME} FROM reactive_v"),
    "reactive_per_series": _with(
        ["pred_v"],
        f"""SELECT round(avg(CAST(actual_cpu > supply AS INTEGER)), 6) AS sla_violation_rate,
                   round({_SURPLUS}, 6) AS over_provision_cost
            FROM (SELECT actual_cpu, coalesce(lag(actual_cpu) OVER (
                      PARTITION BY collection_id, instance_index ORDER BY start_time, row_id),
                      actual_cpu) AS supply
                  FROM pred_v WHERE model = 'lag1')""",
    ),
    "policy_with_baseline": _with(
        ["results_v"], f"SELECT model, threshold, {_OUTCOME} FROM results_v"
    ),
    "accuracy_vs_violation": _with(
        ["study_v"], f"SELECT model, {_round('r2')}, {_OUTCOME} FROM study_v"
    ),
    "pearson_spearman": _with(
        ["corr_v"], f"SELECT {_round('pearson_r', 'spearman_r')}, n FROM corr_v"
    ),
    "correlation_pvalues": _with(
        ["pvalue_v"],
        f"""SELECT {_round('pearson_p', 'spearman_p')}, {_label('pearson_p')} AS pearson_label,
                   {_label('spearman_p')} AS spearman_label
            FROM pvalue_v""",
    ),
    "accuracy_chart": _with(
        ["study_v", "trend_v", "pvalue_v"],
        f"""SELECT model, {_round('r2', 'sla_violation_rate', 'slope', 'intercept', 'pearson_r')},
                   {_label('pearson_p')} AS p_label
            FROM study_v, trend_v, pvalue_v""",
    ),
    "trend_line": _with(
        ["trend_v"],
        """SELECT CAST(point AS INTEGER) AS point, round(x0 + point * (x1 - x0) / 99::DOUBLE, 6) AS x,
                  round(slope * (x0 + point * (x1 - x0) / 99::DOUBLE) + intercept, 6) AS y
           FROM trend_v, range(100) points(point)""",
    ),
    "squared_correlation": _with(
        ["pred_v"],
        """SELECT model, CASE WHEN stddev_pop(predicted_cpu) > 1e-12 THEN
                             round(corr(actual_cpu, predicted_cpu) ** 2, 6) END AS r2
           FROM pred_v GROUP BY model""",
    ),
    "tradeoff_curves": _with(
        ["results_v"],
        f"""SELECT model, CAST(row_number() OVER (PARTITION BY model
                       ORDER BY sla_violation_rate, threshold) AS INTEGER) AS curve_pos,
                   threshold, sla_violation_rate, over_provision_cost
            FROM (SELECT model, threshold, {_OUTCOME} FROM results_v)""",
    ),
    "busiest_series": _with(
        ["usage_v"],
        """SELECT collection_id, instance_index, count(*) AS rows FROM usage_v
           GROUP BY collection_id, instance_index
           ORDER BY count(*) DESC, collection_id, instance_index LIMIT 1""",
    ),
    "series_trace": _with(
        ["pred_v"],
        f"""SELECT collection_id, instance_index, actual_cpu, predicted_cpu,
                   round((start_time - min(start_time) OVER ()) / 60e6::DOUBLE, 6) AS t_min
            FROM (SELECT p.*, count(*) OVER () AS shown FROM (
                      SELECT * FROM pred_v
                      WHERE model = 'lag1' AND (collection_id, instance_index) = (
                          SELECT (collection_id, instance_index) FROM pred_v WHERE model = 'lag1'
                          GROUP BY collection_id, instance_index
                          ORDER BY count(*) DESC, collection_id, instance_index LIMIT 1)
                      ORDER BY start_time, row_id LIMIT {C.TRACE_ROWS}) p)
            WHERE shown >= {C.TRACE_MIN_ROWS}""",
    ),
    "scatter_sample": _sample(C.SAMPLE_ROWS),
    "scatter_sample_1000": _sample(SMALL_SAMPLE),
    "feature_rank_correlation": _with(
        ["clean_v"],
        " UNION ALL ".join(
            f"""SELECT '{f}' AS feature, {_round("pearson_r", "spearman_r")}, n FROM (
                SELECT corr(x, y) AS pearson_r, corr(rx, ry) AS spearman_r, count(*) AS n FROM (
                    SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2::DOUBLE AS rx,
                           rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2::DOUBLE AS ry
                    FROM (SELECT CAST({f} AS DOUBLE) AS x, {C.TARGET} AS y FROM clean_v)))"""
            for f in RANKED_FEATURES
        ),
    ),
    "csv_round_trip": _with(["grid_v"], f"SELECT model, threshold, {_OUTCOME} FROM grid_v"),
    "json_summary": _with(
        ["pvalue_v"],
        f"SELECT {_round('pearson_r', 'pearson_p', 'spearman_r', 'spearman_p')} FROM pvalue_v",
    ),
    "parquet_round_trip": _with(
        ["pred_v"],
        """SELECT * REPLACE (round(predicted_cpu, 6) AS predicted_cpu) FROM pred_v
           WHERE model IN ('lag1', 'peak', 'never_trained')""",
    ),
}

# The same report with a key missing in every tenth row.
ORACLE["null_drop_missing_keys"] = ORACLE["null_drop_report"].replace(
    "CAST(e.event_id % 2 AS BIGINT) AS instance_index",
    "CASE WHEN e.event_id % 10 <> 0 THEN CAST(e.event_id % 2 AS BIGINT) END AS instance_index",
)

_GIVEN = ", ".join(f"('{v.name}', {v.features})" for v in GIVEN)

ORACLE["forest_prediction_rows"] = _with(
    ["ranked_v"],
    f"""SELECT model, start_time, collection_id, instance_index, machine_id, {C.TARGET} AS actual_cpu,
               resource_request_cpu, row_id, true AS in_range
        FROM ranked_v, (VALUES {_GIVEN}) given(model, features)
        WHERE place > CAST(floor(total * {C.TRAIN_SHARE}::DOUBLE) AS BIGINT)""",
)
ORACLE["forest_importance_rows"] = f"""
    SELECT model, unnest(features) AS feature, true AS not_negative, 1.0::DOUBLE AS total
    FROM (VALUES {_GIVEN}) given(model, features)"""


def _tree(depth: int) -> str:
    """The greedy regression tree, level by level: every midpoint of every feature is tried."""
    features = ", ".join(f"CAST({f} AS DOUBLE) AS {f}" for f in C.FEATURES)
    steps = [
        f"""at_0 AS (SELECT 'root' AS node, {C.TARGET} AS y, {features} FROM ranked_v
                     WHERE place <= CAST(floor(total * {C.TRAIN_SHARE}::DOUBLE) AS BIGINT))"""
    ]
    for k in range(depth + 1):
        steps.append(f"""node_{k} AS (SELECT node, avg(y) AS value, count(*) AS n_rows, var_pop(y) * count(*) AS error FROM at_{k} GROUP BY node)""")
        if k == depth:
            break
        steps.append(f"""each_{k} AS (
            SELECT node, feature, x, count(*) AS n, sum(y - value) AS off, any_value(n_rows) AS n_rows, any_value(error) AS error
            FROM (UNPIVOT at_{k} ON {", ".join(C.FEATURES)} INTO NAME feature VALUE x) JOIN node_{k} USING (node)
            GROUP BY node, feature, x)""")
        steps.append(f"""cut_{k} AS (
            SELECT *, sum(n) OVER along AS n_left, sum(off) OVER along AS off_left, lead(x) OVER along AS next_x
            FROM each_{k} WINDOW along AS (PARTITION BY node, feature ORDER BY x))""")
        steps.append(f"""split_{k} AS (
            SELECT DISTINCT ON (node) node, feature, x + (next_x - x) / 2 AS threshold,
                   round(off_left * off_left * (1 / n_left::DOUBLE + 1 / (n_rows - n_left)::DOUBLE) / error, {trees.DIGITS}) AS share, error
            FROM cut_{k} WHERE next_x IS NOT NULL
            ORDER BY node, share DESC, list_position({C.FEATURES}, feature), x)""")
        chosen = " ".join(f"WHEN '{f}' THEN {f}" for f in C.FEATURES)
        steps.append(f"""at_{k + 1} AS (
            SELECT node || CASE WHEN CASE feature {chosen} END <= threshold THEN '.left' ELSE '.right' END AS node, a.* EXCLUDE (node)
            FROM at_{k} a JOIN split_{k} USING (node))""")
    removed = " UNION ALL ".join(f"SELECT feature, share * error AS gain FROM split_{k}" for k in range(depth))
    steps.append(f"gained AS (SELECT feature, sum(gain) AS gain FROM ({removed}) GROUP BY feature)")
    rows = " UNION ALL ".join(
        f"SELECT node, feature, threshold, value, n_rows FROM node_{k} LEFT JOIN split_{k} USING (node)"
        if k < depth
        else f"SELECT node, CAST(NULL AS VARCHAR), CAST(NULL AS DOUBLE), value, n_rows FROM node_{k}"
        for k in range(depth + 1)
    )
    return ",\n".join(steps) + f"""
        SELECT node, feature, round(threshold, 6) AS threshold, round(value, 6) AS value, n_rows,
               round(gain / (SELECT sum(gain) FROM gained), 6) AS importance
        FROM ({rows}) LEFT JOIN gained USING (feature)"""


ORACLE["regression_tree"] = _with(["ranked_v"], "").rstrip() + ",\n" + _tree(TREE_DEPTH)
