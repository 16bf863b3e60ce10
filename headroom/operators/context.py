"""Latest event context per series, and its join onto usage rows."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headroom import contracts as C
from headroom.functions.columns import all_present, present
from headroom.operators.joins import split_join
from headroom.operators.series import CHUNK, SeriesCuts


def events_context(events: DataFrame, schedule_type: int = C.SCHEDULE_TYPE) -> DataFrame:
    """One row per series: its latest schedule event, else its latest other event.

    Preference and "latest" are one number, and every payload column is the one of the row with
    the largest number.  All of it has a fixed width, so events are hashed and never sorted, and a series
    with very many events costs one partial row per task.  A missing time counts as latest; a missing type
    counts as "other".  The whole winning row is taken, so its NULLs are never filled from an
    older event.  ``row_id`` must be unique and from 0 to 2**60 - 1.
    """
    payload = present(events, C.CONTEXT_COLUMNS)
    if "type" in events.columns:
        is_schedule = F.coalesce(F.col("type") == schedule_type, F.lit(False))
    else:
        is_schedule = F.lit(False)
    recency = _recency(is_schedule)
    return (
        events.where(all_present(C.SERIES_KEYS))
        .groupBy(*C.SERIES_KEYS)
        .agg(*[F.max_by(c, recency).alias(c) for c in payload])
    )


ROW_ID_BITS = 60


def _recency(is_schedule: Column) -> Column:
    """(is schedule, has no time, time, row_id) as one number of 126 bits."""
    wide = "decimal(38, 0)"
    flags = is_schedule.cast("int") * 2 + F.col("time").isNull().cast("int")
    since = F.coalesce(F.col("time"), F.lit(0)).cast("decimal(20, 0)") + F.lit(Decimal(2**63))
    usable = F.col("row_id").between(0, 2**ROW_ID_BITS - 1)
    row_id = F.when(usable, F.col("row_id")).otherwise(F.raise_error(F.lit("row_id outside 0..2**60 - 1")).cast("long"))
    upper = (flags.cast("decimal(1, 0)") * F.lit(Decimal(2**64)) + since).cast("decimal(20, 0)")
    return (upper * F.lit(Decimal(2**ROW_ID_BITS)) + row_id.cast("decimal(19, 0)")).cast(wide)


def join_context(
    usage: DataFrame, context: DataFrame, cuts: SeriesCuts | None = None
) -> DataFrame:
    """Left join of the context; clashing context columns get the suffix ``_evt``.

    When long series were cut into chunks, joining on the series key alone would undo the
    cut.  Their context rows (at most one per long series, a bounded table) are broadcast;
    all other rows join on the partitioning that the windows left behind.  Where nobody has looked for long
    series (no ``cuts``), the join finds and splits them itself.
    """
    clash = set(usage.columns) - set(C.SERIES_KEYS)
    context = context.select(
        *C.SERIES_KEYS,
        *[
            F.col(c).alias(f"{c}_evt" if c in clash else c)
            for c in context.columns
            if c not in C.SERIES_KEYS
        ],
    )
    if cuts is None:
        return split_join(usage, context, C.SERIES_KEYS)
    if not cuts or CHUNK not in usage.columns:
        return usage.join(context, C.SERIES_KEYS, "left")
    added = [c for c in context.columns if c not in C.SERIES_KEYS]
    whole = cuts.whole_chunk(context)
    long = F.broadcast(
        cuts.only_long(context).select(*C.SERIES_KEYS, F.struct(*added).alias("of_long"))
    )
    joined = usage.join(whole, [*C.SERIES_KEYS, CHUNK], "left").join(long, C.SERIES_KEYS, "left")
    return joined.select(
        *usage.columns,
        *[
            F.when(F.col(CHUNK) > 0, F.col(f"of_long.{c}")).otherwise(F.col(c)).alias(c)
            for c in added
        ],
    )
