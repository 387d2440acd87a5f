"""Whole-table ordered operations that don't put the table into one task.

A Spark window without PARTITION BY sends every row to one task. Here the
table is cut into ranges of the order columns by sampled quantiles.
A range is numbered and accumulated on its own, and what the ranges before it
add up to (one row a range) is joined on. Offset and sliding frames need their
neighbours: each range of ordinals lends its last rows to the next one.

``order_by`` names columns; ties in all of them have no defined order, so end
it with a unique column. Nulls come first.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS_A_RANGE = 2_000_000
_RANGE, _ROW = "__range", "__row"


def _keys(order_by: str | Sequence[str]) -> list[str]:
    return [order_by] if isinstance(order_by, str) else list(order_by)


def with_ranges(df: DataFrame, order_by: Sequence[str], rows_a_range: int = ROWS_A_RANGE) -> DataFrame:
    """``df`` with the number of each row's range of the order columns, all of them together.

    The cuts are every 20th of a sorted sample of 20 keys a range, so a first
    column of few values or of strings makes no large range. A row finds its
    range among the cuts by binary search.
    """
    n = df.count()
    parts = -(-n // rows_a_range)
    if parts <= 1:
        return df.withColumn(_RANGE, F.lit(0))
    sample = df.select(*order_by).sample(min(1.0, 20.0 * parts / n), seed=7)
    keys = sample.orderBy(*(F.col(c).asc_nulls_first() for c in order_by)).collect()  # about 20 keys a range
    kinds = [df.schema[c].dataType for c in order_by]
    step = max(1, len(keys) // parts)
    cuts = [F.struct(*(F.lit(v).cast(k) for v, k in zip(row, kinds, strict=True))) for row in keys[step::step]]
    if not cuts:
        return df.withColumn(_RANGE, F.lit(0))
    key = F.struct(*(F.col(c).cast(k) for c, k in zip(order_by, kinds, strict=True)))
    table = F.array(*cuts)

    def halve(at: Column, _: Column) -> Column:  # cuts before ``low`` are below the key, those from ``high`` on aren't
        middle = F.floor((at["low"] + at["high"]) / 2).cast("int")
        below = F.get(table, middle) < key
        return F.struct(F.when((at["low"] < at["high"]) & below, middle + 1).otherwise(at["low"]).alias("low"), F.when((at["low"] < at["high"]) & ~below, middle).otherwise(at["high"]).alias("high"))

    rounds = F.array_repeat(F.lit(0), len(cuts).bit_length())
    return df.withColumn(_RANGE, F.aggregate(rounds, F.struct(F.lit(0).alias("low"), F.lit(len(cuts)).alias("high")), halve)["low"])


def _local(order_by: Sequence[str]) -> Window:
    return Window.partitionBy(_RANGE).orderBy(*(F.col(c).asc_nulls_first() for c in order_by))


def _before(df: DataFrame, total: Column, combine: Callable[[Column], Column]) -> DataFrame:
    """(range, before): ``total`` of all earlier ranges combined; one row a range, so one task is enough."""
    totals = df.groupBy(_RANGE).agg(total.alias("__total"))
    earlier = Window.orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    x = F.col("__total")
    before = combine(x).over(earlier)
    if combine is F.min and isinstance(totals.schema["__total"].dataType, (T.FloatType, T.DoubleType)):
        before = F.when(F.max(F.isnan(x)).over(earlier), float("nan")).otherwise(before)
    return totals.select(_RANGE, before.alias("__before"))


def with_row_index(df: DataFrame, order_by: str | Sequence[str], name: str = "index", rows_a_range: int = ROWS_A_RANGE) -> DataFrame:
    """``df`` with the 0-based position of each row in the given order."""
    keys = _keys(order_by)
    ranged = with_ranges(df, keys, rows_a_range)
    before = _before(ranged, F.count(F.lit(1)), F.sum)
    inner = F.row_number().over(_local(keys)) - 1
    out = ranged.withColumn(name, inner).join(F.broadcast(before), _RANGE)
    return out.withColumn(name, (F.col(name) + F.coalesce("__before", F.lit(0))).cast("long")).select(*df.columns, name)


def running(df: DataFrame, column: str, kind: str, order_by: str | Sequence[str], partition_by: Sequence[str] = (), name: str | None = None, rows_a_range: int = ROWS_A_RANGE) -> DataFrame:
    """``df`` with the running ``sum``, ``product``, ``max`` or ``min`` of a column, nulls skipped.

    A running max or min turns NaN at the first NaN.
    """
    keys, name = _keys(order_by), name or column
    kinds = {"sum": (F.sum, lambda a, b: a + b), "product": (F.product, lambda a, b: a * b), "max": (F.max, F.greatest), "min": (F.min, F.least)}
    fold, join = kinds[kind]
    value = F.col(column)
    real = isinstance(df.schema[column].dataType, (T.FloatType, T.DoubleType))
    original = df.schema[column].dataType
    kept = original if kind in ("max", "min") else T.DoubleType() if real else original

    def over(x: Column, window) -> Column:
        out = fold(x).over(window)
        if real and kind == "min":
            out = F.when(F.max(F.isnan(x)).over(window), float("nan")).otherwise(out)
        return out

    if partition_by:
        window = Window.partitionBy(*partition_by).orderBy(*(F.col(c).asc_nulls_first() for c in keys)).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(name, over(value, window).cast(kept))
    ranged = with_ranges(df, keys, rows_a_range)
    total = fold(value)
    if real and kind == "min":
        total = F.when(F.max(F.isnan(value)), float("nan")).otherwise(total)
    before = _before(ranged, total, fold)
    local = _local(keys).rowsBetween(Window.unboundedPreceding, 0)
    here = ranged.withColumn("__here", over(value, local)).join(F.broadcast(before), _RANGE)
    a, b = F.col("__before"), F.col("__here")
    both = join(a, b)
    if real and kind == "min":
        both = F.when(F.isnan(a) | F.isnan(b), float("nan")).otherwise(both)
    out = F.when(a.isNull(), b).when(b.isNull(), a).otherwise(both).cast(kept)
    found = here.withColumn("__out", out)
    names = df.columns if name in df.columns else [*df.columns, name]
    return found.select(*(F.col("__out").alias(c) if c == name else F.col(c) for c in names))


def framed(df: DataFrame, order_by: str | Sequence[str], back: int, ahead: int, make: Callable[[Window], dict[str, Column]], partition_by: Sequence[str] = (), rows_a_range: int = ROWS_A_RANGE) -> DataFrame:
    """``df`` with columns over frames that reach ``back`` rows before and ``ahead`` after each row.

    ``make`` gets a window (partitioned and ordered, without a frame) and returns
    the columns by name. Ranges of ordinals borrow the rows that their frames
    reach into.
    """
    keys = _keys(order_by)
    if partition_by:
        window = Window.partitionBy(*partition_by).orderBy(*(F.col(c).asc_nulls_first() for c in keys))
        return df.withColumns(make(window))
    indexed = with_row_index(df, keys, _ROW, rows_a_range)
    size = max(rows_a_range, back + ahead + 1)
    home = F.floor(F.col(_ROW) / size).cast("long")
    first, last = F.floor((F.col(_ROW) - ahead) / size).cast("long"), F.floor((F.col(_ROW) + back) / size).cast("long")
    # A row that others' frames reach also goes to their ranges, at most one on either side.
    lent = indexed.withColumn("__home", home).withColumn(_RANGE, F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))
    window = Window.partitionBy(_RANGE).orderBy(_ROW)
    made = make(window)
    return lent.withColumns(made).where(F.col(_RANGE) == F.col("__home")).drop(_RANGE, "__home", _ROW)
