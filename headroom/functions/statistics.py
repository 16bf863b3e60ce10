"""Accuracy and correlation statistics as single aggregates.

Divisions go through ``try_divide``: a constant column or a zero sum gives NULL instead of
an error, and never NaN.
"""

from __future__ import annotations

from math import pi, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from headroom.functions.columns import all_present
from headroom.operators.joins import split_join
from headroom.operators.ordering import range_number
from headroom.sources.staging import stage


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def r_squared(actual: str | Column, predicted: str | Column) -> Column:
    """``1 - SSE / SST``; NULL when the actual values are constant."""
    y, p = _col(actual), _col(predicted)
    squared_error = F.sum((y - p) * (y - p))
    return 1 - F.try_divide(squared_error, F.var_pop(y) * F.count(y))


def mean_absolute_error(actual: str | Column, predicted: str | Column) -> Column:
    return F.avg(F.abs(_col(actual) - _col(predicted)))


def root_mean_squared_error(actual: str | Column, predicted: str | Column) -> Column:
    error = _col(actual) - _col(predicted)
    return F.sqrt(F.avg(error * error))


def regression_metrics(
    predictions: DataFrame, actual: str = "actual_cpu", predicted: str = "predicted_cpu"
) -> DataFrame:
    """r2, mae and rmse of every model in one pass."""
    return predictions.groupBy("model").agg(
        r_squared(actual, predicted).cast("double").alias("r2"),
        mean_absolute_error(actual, predicted).cast("double").alias("mae"),
        root_mean_squared_error(actual, predicted).cast("double").alias("rmse"),
    )


def pearson(x: str | Column, y: str | Column) -> Column:
    """Correlation coefficient; NULL when either side is constant."""
    x, y = _col(x), _col(y)
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return F.when(r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def squared_correlation(x: str | Column, y: str | Column) -> Column:
    r = pearson(x, y)
    return r * r


def average_rank(column: str) -> Column:
    """``average_ranks`` for a result table with one row per model: its window has no partition."""
    ties = F.count(F.lit(1)).over(W.partitionBy(column))
    return F.rank().over(W.orderBy(column)) + (ties - 1) / 2


def average_ranks(rows: DataFrame, column: str, output: str) -> DataFrame:
    """``rows`` with the rank of ``column``, ties sharing their mean rank; rows without a value have none.

    Equal values are one row with a count before anything is ordered.  Values are cut into ranges, counted up
    inside each, and every range starts where the ones before it end: one row per range.  A frequent value
    doesn't slow the join back.
    """
    counts = rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("ties"))
    counts = stage(counts, "values")
    counts = counts.withColumn("range_id", range_number(counts, [column]))
    inside = W.partitionBy("range_id").orderBy(column).rowsBetween(W.unboundedPreceding, W.currentRow)
    sizes = counts.groupBy("range_id").agg(F.sum("ties").alias("size"))
    before = sizes.select("range_id", (F.sum("size").over(W.orderBy("range_id")) - F.col("size")).alias("before"))
    # as many rows as ranges
    ranked = counts.withColumn("upto", F.sum("ties").over(inside)).join(F.broadcast(before), "range_id")
    rank = (F.col("before") + F.col("upto")).cast("double") - (F.col("ties") - 1) / 2
    return split_join(rows, ranked.select(column, rank.alias(output)), [column])


#: Terms of the continued fraction, and shifts before the series for the ratio of gamma functions.
FRACTION_TERMS = 160
GAMMA_SHIFTS = 12


def _log_gamma_half(a: Column) -> Column:
    """``log(gamma(a + 1/2) / gamma(a))``: its asymptotic series at ``a + GAMMA_SHIFTS``, taken back step by step."""
    w = 1 / ((a + GAMMA_SHIFTS) * (a + GAMMA_SHIFTS))
    inner = 1 / 8 - w * (1 / 192 - w * (1 / 640 - w * (17 / 14336 - w * 31 / 18432)))
    series = F.log(a + GAMMA_SHIFTS) / 2 - inner / (a + GAMMA_SHIFTS)
    steps = F.sequence(F.lit(0), F.lit(GAMMA_SHIFTS - 1))
    return F.aggregate(steps, series, lambda s, k: s + F.log((a + k) / (a + k + 0.5)))


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed and written out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function, evaluated forward over a fixed number of terms."""
    tiny = F.lit(1e-300)

    def safe(v: Column) -> Column:
        return F.when(F.abs(v) < tiny, tiny).otherwise(v)

    first = 1 / safe(1 - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))

    def step(s: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return _next_term(_next_term(s, even, safe), odd, safe)

    return F.aggregate(F.sequence(F.lit(1), F.lit(FRACTION_TERMS)), start, step, lambda s: s["h"])


def _next_term(s: Column, term: Column, safe) -> Column:
    moved = _let(s, lambda s: F.struct(safe(1 + term / s["c"]).alias("c"), (1 / safe(1 + term * s["d"])).alias("d"), s["h"].alias("h")))
    return _let(moved, lambda v: F.struct(v["c"].alias("c"), v["d"].alias("d"), (v["h"] * v["c"] * v["d"]).alias("h")))


def two_sided_p(r: Column, n: Column) -> Column:
    """Two-sided p-value of a correlation ``r`` over ``n`` rows (t law, n - 2 degrees).

    It is the incomplete beta function at ``1 - r**2`` with parameters ``dof / 2`` and ``1 / 2``, from a continued fraction
    of fixed length on whichever side of the mean it converges fast, so the cost doesn't depend on ``n``.
    """
    dof = (n - 2).cast("double")
    given = F.when((dof > 0) & r.isNotNull(), F.struct((dof / 2).alias("a"), F.abs(r).alias("r"), (r * r).alias("y")))

    def p(v: Column) -> Column:
        a, y, half = v["a"], v["y"], F.lit(0.5)
        x = F.greatest((1 - v["r"]) * (1 + v["r"]), F.lit(0.0))
        # x**a * y**(1/2) / B(a, 1/2); log1p keeps a tiny y next to a large a
        log_x = F.when(y < 0.5, F.log1p(-y)).otherwise(F.log(F.greatest(x, F.lit(1e-300))))
        front = F.exp(a * log_x + _log_gamma_half(a)) * v["r"] / F.lit(sqrt(pi))
        # either side is right; the first needs few terms while t**2 is below about 15
        near = 1 - front / half * _beta_fraction(half, a, y)
        return F.when(y < 7.5 / (a + 9), near).otherwise(front / a * _beta_fraction(a, half, x))

    bounded = _let(given, lambda v: F.when(v.isNotNull(), p(v)))
    return _let(bounded, lambda v: F.when(v.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))))


def correlation_summary(rows: DataFrame, x: str, y: str, per_model: bool = False) -> DataFrame:
    """One row: Pearson and Spearman coefficients with their p-values, and the row count.

    ``per_model`` says that ``rows`` is a result table with one row per model, which needs no distributed ranks.
    """
    filled = rows.where(all_present([x, y])).select(x, y)
    if per_model:
        ranked = filled.select("*", average_rank(x).alias("x_rank"), average_rank(y).alias("y_rank"))
    else:
        ranked = average_ranks(average_ranks(filled, x, "x_rank"), y, "y_rank")
    totals = ranked.agg(
        pearson(x, y).alias("pearson_r"),
        pearson("x_rank", "y_rank").alias("spearman_r"),
        F.count(F.lit(1)).alias("n"),
    )
    n, r, rho = F.col("n"), F.col("pearson_r"), F.col("spearman_r")
    # Two points always lie on a line: that fit says nothing, hence p = 1.
    pearson_p = F.when((n == 2) & r.isNotNull(), F.lit(1.0)).otherwise(two_sided_p(r, n))
    return totals.select(
        "pearson_r",
        pearson_p.alias("pearson_p"),
        "spearman_r",
        two_sided_p(rho, n).alias("spearman_p"),
        "n",
    )


def trend(x: str, y: str) -> tuple[Column, Column]:
    """Slope and intercept of the least-squares line; NULL for fewer than two points."""
    enough = F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)) > 1
    return F.when(enough, F.regr_slope(y, x)), F.when(enough, F.regr_intercept(y, x))
