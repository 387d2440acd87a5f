"""Joins, set operations and groupings beyond equality: what a table user expects of a query engine.

Keys that are null match nothing, but in the set operations, where they are equal.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _on(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]]) -> Column:
    out = F.lit(True)
    for a, b in keys:
        out = out & (left[a] == right[b])
    return out


def semi_join(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]]) -> DataFrame:
    """The rows of ``left`` that have a partner, each once."""
    return left.join(right, _on(left, right, keys), "left_semi")


def anti_join(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]]) -> DataFrame:
    """The rows of ``left`` without a partner."""
    return left.join(right, _on(left, right, keys), "left_anti")


def multi_key_join(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]], how: str = "inner") -> DataFrame:
    """A join on several pairs of columns; all columns of both sides."""
    return left.join(right, _on(left, right, keys), how)


def range_join(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, width: float) -> DataFrame:
    """Points with the ranges [low, high) that hold them.

    Both sides are cut into cells of ``width`` and joined on these, so no side
    meets all of the other; a range is in as many cells as it touches.
    """
    cell = lambda c: F.floor(F.col(c) / width).cast("long")
    a = points.withColumn("__cell", cell(at))
    b = ranges.where(F.col(low) < F.col(high)).withColumn("__cell", F.explode(F.sequence(cell(low), cell(high))))
    return a.join(b, "__cell").where((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("__cell")


def as_of_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_at: str, right_at: str, columns: Sequence[str]) -> DataFrame:
    """``left`` with ``columns`` of the last row of ``right`` (same ``by``) at or before its time; null without one.

    Both sides go through one window by key and time, so a row never meets all rows of its key.
    """
    names = [f"__of_{c}" for c in columns]
    value = F.struct(*(F.col(c) for c in columns))
    a = left.withColumns({"__at": F.col(left_at), "__side": F.lit(1), "__value": F.lit(None)})
    b = right.select(*by, F.col(right_at).alias("__at"), F.lit(0).alias("__side"), value.alias("__value"))
    both = b.unionByName(a.withColumn("__value", F.lit(None).cast(b.schema["__value"].dataType)), allowMissingColumns=True)
    order = Window.partitionBy(*by).orderBy(F.col("__at").asc_nulls_first(), "__side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__found", F.last("__value", ignorenulls=True).over(order)).where("__side = 1")
    known = F.lit(True)
    for c in (*by, "__at"):
        known = known & F.col(c).isNotNull()
    out = found.select(*left.columns, *(F.when(known, F.col(f"__found.{c}")).alias(n) for c, n in zip(columns, names, strict=True)))
    return out.withColumnsRenamed(dict(zip(names, columns, strict=True)))


def ranks(df: DataFrame, by: Sequence[str], order: Sequence[Column], tiles: int = 4) -> DataFrame:
    """``df`` with row_number, rank, dense_rank, percent_rank, cume_dist and ntile within groups."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumns({"row_number": F.row_number().over(w), "rank": F.rank().over(w), "dense_rank": F.dense_rank().over(w), "percent_rank": F.percent_rank().over(w), "cume_dist": F.cume_dist().over(w), "ntile": F.ntile(tiles).over(w)})


def rollup(df: DataFrame, by: Sequence[str], **aggregates: Column) -> DataFrame:
    """Aggregates by all of ``by``, by all but the last, and so on; ``level`` says which columns are left out, as bits."""
    return df.rollup(*by).agg(F.grouping_id().alias("level"), *(v.alias(k) for k, v in aggregates.items()))


def cube(df: DataFrame, by: Sequence[str], **aggregates: Column) -> DataFrame:
    """Aggregates by every subset of ``by``."""
    return df.cube(*by).agg(F.grouping_id().alias("level"), *(v.alias(k) for k, v in aggregates.items()))


def intersect(left: DataFrame, right: DataFrame, every: bool = False) -> DataFrame:
    """The rows in both, once each, or (``every``) as often as in both."""
    return left.intersectAll(right) if every else left.intersect(right)


def except_(left: DataFrame, right: DataFrame, every: bool = False) -> DataFrame:
    """The rows of ``left`` that ``right`` doesn't have, once each, or (``every``) less one for each there."""
    return left.exceptAll(right) if every else left.subtract(right)
