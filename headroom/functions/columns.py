"""Column expressions: everything here stays inside whole-stage code generation."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from headroom import contracts as C

HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US
FLOATING = (T.DoubleType, T.FloatType)


def present(df: DataFrame, wanted: list[str]) -> list[str]:
    """The names of ``wanted`` that ``df`` has, in the order asked for."""
    have = set(df.columns)
    return [name for name in wanted if name in have]


def select_present(df: DataFrame, wanted: list[str]) -> DataFrame:
    """Keep only the listed columns that exist."""
    return df.select(*present(df, wanted))


def missing(df: DataFrame, wanted: list[str]) -> list[str]:
    """The names of ``wanted`` that ``df`` lacks, sorted."""
    return sorted(set(wanted) - set(df.columns))


def with_default(df: DataFrame, name: str, value: float | None = None) -> DataFrame:
    """Add a double column holding ``value`` when ``df`` has no column ``name``."""
    if name in df.columns:
        return df
    return df.withColumn(name, F.lit(value).cast("double"))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in every top-level floating column.

    NaN means "missing" in the source files.  Spark sorts NaN above every number and
    lets it poison averages, so it is replaced once, at ingest.
    """
    return df.selectExpr(
        *[
            f"CASE WHEN NOT isnan(`{f.name}`) THEN `{f.name}` END AS `{f.name}`"
            if isinstance(f.dataType, FLOATING)
            else f"`{f.name}`"
            for f in df.schema.fields
        ]
    )


def all_present(columns: list[str]) -> Column:
    """True when no listed column is NULL."""
    return F.expr(" AND ".join(f"`{c}` IS NOT NULL" for c in columns))


def is_filled(df: DataFrame, columns: list[str]) -> Column:
    """True when no listed column is NULL (or NaN, for floating columns).

    Written as a conjunction of ``IS NOT NULL`` rather than ``dropna`` so that Catalyst
    sees each test: it can push them to scans and turn an outer join into an inner one.
    """
    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, FLOATING)}
    tests = [f"`{c}` IS NOT NULL" for c in columns]
    tests += [f"NOT isnan(`{c}`)" for c in columns if c in floating]
    return F.expr(" AND ".join(tests) or "true")


def element_or_null(array: str | Column, index: int) -> Column:
    """Zero-based array element as a double; NULL when absent or too short."""
    return F.get(array, F.lit(index)).cast("double")


def trace_timestamp(offset_us: str | Column, epoch: str = C.TRACE_EPOCH) -> Column:
    """Zone-free UTC timestamp of a microsecond offset from ``epoch``."""
    start = F.lit(epoch).cast("timestamp_ntz")
    return F.timestamp_add("MICROSECOND", offset_us, start)


def local_micros(
    offset_us: str | Column, zone: str = C.CELL_ZONE, epoch: str = C.TRACE_EPOCH
) -> Column:
    """Wall-clock time in ``zone`` as microseconds since 1970; no session zone involved.

    ``from_utc_timestamp`` shifts the microseconds by the zone's offset at that instant and
    resolves the zone once per task, where ``convert_timezone`` does so once per row.
    """
    offset = F.col(offset_us) if isinstance(offset_us, str) else offset_us
    since_1970 = int(datetime.fromisoformat(epoch).replace(tzinfo=UTC).timestamp()) * 1_000_000
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(offset + since_1970), zone))


def local_time(
    offset_us: str | Column, zone: str = C.CELL_ZONE, epoch: str = C.TRACE_EPOCH
) -> Column:
    """Wall-clock time in ``zone`` as a zone-free timestamp."""
    return trace_timestamp(local_micros(offset_us, zone, epoch), "1970-01-01")


def hour_of_day(local_us: Column) -> Column:
    """Hour 0 to 23 of a wall-clock time given in microseconds since 1970."""
    return F.floor(F.pmod(local_us, F.lit(DAY_US)) / HOUR_US).cast("int")


def day_of_week(local_us: Column) -> Column:
    """Weekday of such a time, Monday = 0; 1970-01-01 was a Thursday."""
    return F.floor(F.pmod(local_us + 3 * DAY_US, F.lit(7 * DAY_US)) / DAY_US).cast("int")


def minutes_between(later: Column, earlier: Column) -> Column:
    return (later - earlier) / F.lit(60e6)


def usable_capacity(capacity: str | Column) -> Column:
    """Requested CPU with NULL and non-positive values replaced by the default."""
    value = F.col(capacity) if isinstance(capacity, str) else capacity
    filled = F.coalesce(F.nanvl(value, F.lit(None).cast("double")), F.lit(C.DEFAULT_CAPACITY))
    return F.when(filled <= 0, F.lit(C.DEFAULT_CAPACITY)).otherwise(filled)


def p_value_label(p: str | Column) -> Column:
    value = F.col(p) if isinstance(p, str) else p
    return (
        F.when(value.isNull(), F.lit(None).cast("string"))
        .when(value < 0.001, F.lit("p < 0.001"))
        .otherwise(F.format_string("p = %.3f", value))
    )


def precedes_or_is(columns: list[str], key: tuple) -> Column:
    """Row order test ``(columns) <= key``, written out lexicographically.

    Spelled with plain comparisons instead of a struct comparison so that Parquet scans
    can use it to skip row groups.
    """
    name, value, rest = columns[0], key[0], columns[1:]
    here, bound = F.col(name), F.lit(value)
    if not rest:
        return here <= bound
    return (here < bound) | ((here == bound) & precedes_or_is(rest, key[1:]))
