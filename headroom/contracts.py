"""Table contracts and default parameters shared by every module.

A *series* is one instance: rows with the same ``(collection_id, instance_index)``
ordered by ``start_time``.  Times are microseconds from the trace epoch.  ``row_id``
is the declared last tie-break, so every order in the library is total.
"""

from __future__ import annotations

from pyspark.sql import types as T

_LONG, _DOUBLE, _STRING = T.LongType(), T.DoubleType(), T.StringType()
_CURVE = T.ArrayType(_DOUBLE)


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


# --- Fixed values: names, codes and constants that results depend on -------------------

SERIES_KEYS = ["collection_id", "instance_index"]
SERIES_ORDER = ["start_time", "row_id"]
TIME_ORDER = ["start_time", "collection_id", "instance_index", "row_id"]

LAG_FEATURES = [
    "avg_cpu_lag1",
    "avg_cpu_lag2",
    "avg_cpu_lag3",
    "max_cpu_lag1",
    "avg_memory_lag1",
]
STAT_FEATURES = [
    "avg_cpu_roll_mean6",
    "avg_cpu_roll_std6",
    "cpu_p90",
    "cpu_p95",
    "cycles_per_instruction",
    "memory_accesses_per_instruction",
]
CONTEXT_FEATURES = [
    "priority",
    "scheduling_class",
    "collection_type",
    "resource_request_cpu",
    "resource_request_memory",
    "hour_of_day",
    "day_of_week",
]
FEATURES = LAG_FEATURES + STAT_FEATURES + CONTEXT_FEATURES
TARGET = "avg_cpu_target"
META = [
    "start_time",
    "end_time",
    "collection_id",
    "instance_index",
    "machine_id",
    "avg_cpu",
    "avg_memory",
    "max_cpu",
    "assigned_memory",
]
CONTEXT_COLUMNS = [
    "priority",
    "scheduling_class",
    "resource_request_cpu",
    "resource_request_memory",
]

TRACE_EPOCH = "2019-05-01"
CELL_ZONE = "America/New_York"
SEVEN_DAYS_US = 7 * 24 * 3600 * 1_000_000
SCHEDULE_TYPE = 1
MACHINE_TYPES = (0, 1)
P90_INDEX = 9
P95_INDEX = 4
ROLLING_ROWS = 6

TRAIN_SHARE = 0.8
FOLDS = 3
THRESHOLDS = (0.5, 0.6, 0.7, 0.8, 0.9)
STUDY_THRESHOLD = 0.7
SAFETY_MARGIN = 1.1
DEFAULT_CAPACITY = 1.0
BASELINE_MODEL = "reactive_baseline"
BEST_MODEL = "full_model"

TOP_FEATURES = 15
SAMPLE_ROWS = 10_000
SEED = 42
TRACE_ROWS = 200
TRACE_MIN_ROWS = 5
LINE_POINTS = 100

# --- Schemas ---------------------------------------------------------------------------

USAGE_SOURCE = _table(
    start_time=_LONG,
    end_time=_LONG,
    collection_id=_LONG,
    instance_index=_LONG,
    machine_id=_LONG,
    alloc_collection_id=_LONG,
    alloc_instance_index=_LONG,
    collection_type=_LONG,
    average_usage=_table(cpus=_DOUBLE, memory=_DOUBLE),
    maximum_usage=_table(cpus=_DOUBLE, memory=_DOUBLE),
    assigned_memory=_DOUBLE,
    cycles_per_instruction=_DOUBLE,
    memory_accesses_per_instruction=_DOUBLE,
    cpu_usage_distribution=_CURVE,
    tail_cpu_usage_distribution=_CURVE,
    sample_rate=_DOUBLE,
    row_id=_LONG,
)

USAGE = _table(
    start_time=_LONG,
    end_time=_LONG,
    collection_id=_LONG,
    instance_index=_LONG,
    machine_id=_LONG,
    alloc_collection_id=_LONG,
    alloc_instance_index=_LONG,
    collection_type=_LONG,
    avg_cpu=_DOUBLE,
    avg_memory=_DOUBLE,
    max_cpu=_DOUBLE,
    max_memory=_DOUBLE,
    assigned_memory=_DOUBLE,
    cycles_per_instruction=_DOUBLE,
    memory_accesses_per_instruction=_DOUBLE,
    cpu_usage_distribution=_CURVE,
    tail_cpu_usage_distribution=_CURVE,
    sample_rate=_DOUBLE,
    row_id=_LONG,
)

INSTANCE_EVENTS_SOURCE = _table(
    time=_LONG,
    type=_LONG,
    collection_id=_LONG,
    instance_index=_LONG,
    machine_id=_LONG,
    priority=_LONG,
    scheduling_class=_LONG,
    collection_type=_LONG,
    resource_request=_table(cpus=_DOUBLE, memory=_DOUBLE),
    alloc_collection_id=_LONG,
    row_id=_LONG,
)

INSTANCE_EVENTS = _table(
    time=_LONG,
    type=_LONG,
    collection_id=_LONG,
    instance_index=_LONG,
    machine_id=_LONG,
    priority=_LONG,
    scheduling_class=_LONG,
    collection_type=_LONG,
    resource_request_cpu=_DOUBLE,
    resource_request_memory=_DOUBLE,
    alloc_collection_id=_LONG,
    row_id=_LONG,
)

MACHINE_EVENTS_SOURCE = _table(
    time=_LONG,
    machine_id=_LONG,
    type=_LONG,
    capacity=_table(cpus=_DOUBLE, memory=_DOUBLE),
)

MACHINE_EVENTS = _table(
    time=_LONG,
    machine_id=_LONG,
    type=_LONG,
    capacity_cpu=_DOUBLE,
    capacity_memory=_DOUBLE,
)

_LONG_FEATURES = {"priority", "scheduling_class", "collection_type"}
_INT_FEATURES = {"hour_of_day", "day_of_week"}
_LONG_META = {"start_time", "end_time", "collection_id", "instance_index", "machine_id"}


def _feature_type(name: str) -> T.DataType:
    if name in _INT_FEATURES:
        return T.IntegerType()
    return _LONG if name in _LONG_FEATURES | _LONG_META else _DOUBLE


FEATURE_TABLE = T.StructType(
    [T.StructField(c, _feature_type(c)) for c in META + FEATURES + [TARGET]]
    + [T.StructField("row_id", _LONG)]
)

PREDICTIONS = _table(
    model=_STRING,
    start_time=_LONG,
    collection_id=_LONG,
    instance_index=_LONG,
    machine_id=_LONG,
    actual_cpu=_DOUBLE,
    predicted_cpu=_DOUBLE,
    resource_request_cpu=_DOUBLE,
    row_id=_LONG,
)

MODEL_METRICS = _table(
    model=_STRING, r2=_DOUBLE, mae=_DOUBLE, rmse=_DOUBLE, best_params=_STRING
)
FEATURE_IMPORTANCES = _table(model=_STRING, feature=_STRING, importance=_DOUBLE)
POLICY_RESULTS = _table(
    model=_STRING,
    threshold=_DOUBLE,
    sla_violation_rate=_DOUBLE,
    over_provision_cost=_DOUBLE,
)
STUDY_ROWS = _table(
    model=_STRING, r2=_DOUBLE, sla_violation_rate=_DOUBLE, over_provision_cost=_DOUBLE
)
STUDY_SUMMARY = _table(
    pearson_r=_DOUBLE, pearson_p=_DOUBLE, spearman_r=_DOUBLE, spearman_p=_DOUBLE
)
