"""Aggregate columns for ``df.agg`` and ``df.groupBy(...).agg``, with defined results for empty input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")


def _x(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Numbers: null is skipped; without values a sum is 0, a mean NaN, an extreme null.


def sum_(c) -> Column:
    return F.coalesce(F.sum(_x(c)), F.lit(0.0))


def mean(c) -> Column:
    return F.coalesce(F.avg(_x(c)), F.lit(NAN))


def var(c) -> Column:
    """Population variance."""
    return F.coalesce(F.var_pop(_x(c)), F.lit(NAN))


def std(c) -> Column:
    """Population standard deviation."""
    return F.coalesce(F.stddev_pop(_x(c)), F.lit(NAN))


def min_(c) -> Column:
    return F.min(_x(c))


def max_(c) -> Column:
    return F.max(_x(c))


def median(c) -> Column:
    return F.coalesce(F.median(_x(c)), F.lit(NAN))


def quantile(c, q: float) -> Column:
    """Exact, linear between the neighbours."""
    return F.coalesce(F.percentile(_x(c), F.lit(q)), F.lit(NAN))


def count(c) -> Column:
    return F.count(_c(c))


def nunique(c) -> Column:
    return F.count_distinct(_c(c))


def product(c) -> Column:
    return F.coalesce(F.product(_x(c)), F.lit(1.0))


def min_nan(c) -> Column:
    """The minimum, NaN if any value is NaN."""
    return F.when(F.max(F.isnan(_x(c))), F.lit(NAN)).otherwise(F.min(_x(c)))


# Strings.


def str_min(c) -> Column:
    return F.min(_c(c))


def str_max(c) -> Column:
    return F.max(_c(c))


def str_concat(c, order_by: str | Column, sep: str = "") -> Column:
    """The non-null strings in order, joined."""
    pairs = F.array_sort(F.collect_list(F.when(_c(c).isNotNull(), F.struct(_c(order_by).alias("o"), _c(c).alias("s")))))
    return F.array_join(F.transform(pairs, lambda p: p["s"]), sep)


def str_unique(c) -> Column:
    return F.array_sort(F.collect_set(_c(c)))


def str_nunique(c) -> Column:
    return F.count_distinct(_c(c))


def str_mode(c) -> Column:
    """The most frequent string; of several the smallest."""
    return F.mode(_c(c), deterministic=True)


# Booleans.


def bool_all(c) -> Column:
    """Whether no value is false; null doesn't count."""
    return F.coalesce(F.bool_and(F.coalesce(_c(c), F.lit(True))), F.lit(True))


def bool_any(c) -> Column:
    return F.coalesce(F.bool_or(F.coalesce(_c(c), F.lit(False))), F.lit(False))


def bool_sum(c) -> Column:
    return F.count_if(_c(c))


def bool_mean(c) -> Column:
    return F.coalesce(F.avg(_c(c).cast("double")), F.lit(NAN))
