"""Reductions across the columns of a row, as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frame import select_columns

NAN = float("nan")


def _values(df: DataFrame, names: Sequence[str]) -> list[Column]:
    """The numeric ones of the named columns as double, null as NaN; others are left out."""
    numeric = set(select_columns(df, "numeric"))
    return [F.coalesce(F.col(n).cast("double"), F.lit(NAN)) for n in names if n in numeric]


def _sum(xs: Sequence[Column], zero: float = 0.0) -> Column:
    return reduce(lambda a, b: a + b, xs, F.lit(zero))


def _guarded(xs: list[Column], skipna: bool, result: Column) -> Column:
    """NaN if anything is NaN and that isn't to be skipped."""
    if skipna or not xs:
        return result
    return F.when(reduce(lambda a, b: a | b, map(F.isnan, xs)), NAN).otherwise(result)


def row_sum(df: DataFrame, names: Sequence[str], skipna: bool = True) -> Column:
    xs = _values(df, names)
    return _guarded(xs, skipna, _sum([F.nanvl(x, F.lit(0.0)) for x in xs]))


def row_mean(df: DataFrame, names: Sequence[str], skipna: bool = True) -> Column:
    xs = _values(df, names)
    n = _sum([F.when(F.isnan(x), 0.0).otherwise(1.0) for x in xs])
    mean = F.when(n > 0, F.try_divide(_sum([F.nanvl(x, F.lit(0.0)) for x in xs]), n)).otherwise(NAN)
    return _guarded(xs, skipna, mean)


def _extreme(df: DataFrame, names: Sequence[str], skipna: bool, pick) -> Column:
    xs = _values(df, names)
    known = [F.when(~F.isnan(x), x) for x in xs]
    if not xs:
        return F.lit(NAN)
    found = pick(*known) if len(known) > 1 else known[0]
    return _guarded(xs, skipna, F.coalesce(found, F.lit(NAN)))


def row_min(df: DataFrame, names: Sequence[str], skipna: bool = True) -> Column:
    return _extreme(df, names, skipna, F.least)


def row_max(df: DataFrame, names: Sequence[str], skipna: bool = True) -> Column:
    return _extreme(df, names, skipna, F.greatest)


def dot(df: DataFrame, names: Sequence[str], weights: Sequence[float]) -> Column:
    """The weighted sum; null and non-finite terms count as 0."""
    if len(names) != len(weights):
        raise ValueError("as many weights as names are needed")
    terms = [F.coalesce(F.col(n).cast("double"), F.lit(NAN)) * F.lit(float(w)) for n, w in zip(names, weights, strict=True)]
    return _sum([F.when(F.isnan(t) | (F.abs(t) == float("inf")), 0.0).otherwise(t) for t in terms])


def row_all(names: Sequence[str]) -> Column:
    """Whether all are true; null is false."""
    return reduce(lambda a, b: a & b, (F.coalesce(F.col(n), F.lit(False)) for n in names), F.lit(True))


def row_any(names: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.coalesce(F.col(n), F.lit(False)) for n in names), F.lit(False))
