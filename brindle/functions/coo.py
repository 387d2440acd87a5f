"""Tensors in long form: one row a cell, index columns and a value column ``v``.

Contractions are joins on the shared index and a grouped sum; absent cells are
0. This is the form for what doesn't fit a row: every operation is a join, a
projection or an aggregation that Spark distributes.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def from_vectors(df: DataFrame, row: str, vector: str, i: str = "i", j: str = "j") -> DataFrame:
    """Cells of a matrix whose rows are an array column."""
    return df.select(F.col(row).alias(i), F.posexplode(vector).alias(j, "v"))


def to_vectors(t: DataFrame, i: str = "i", j: str = "j") -> DataFrame:
    """Rows as arrays in the order of ``j``; a row must fit one task."""
    pairs = F.array_sort(F.collect_list(F.struct(j, "v")))
    return t.groupBy(i).agg(F.transform(pairs, lambda p: p["v"]).alias("v"))


def eye(spark: SparkSession, n: int, m: int | None = None, k: int = 0) -> DataFrame:
    """The cells of ones on diagonal ``k``; others are absent."""
    m = n if m is None else m
    return spark.range(n).select(F.col("id").alias("i"), (F.col("id") + k).alias("j"), F.lit(1.0).alias("v")).where(F.col("j").between(0, m - 1))


def meshgrid(x: DataFrame, y: DataFrame) -> DataFrame:
    """All combinations of two index tables: small operands by nature, as the result is their product."""
    return x.crossJoin(F.broadcast(y))


def transpose(t: DataFrame, axes: dict[str, str] | None = None) -> DataFrame:
    """Index columns renamed: i and j swapped, or as ``axes`` says (old: new)."""
    axes = axes or {"i": "j", "j": "i"}
    return t.select(*(F.col(c).alias(axes.get(c, c)) for c in t.columns))


def tril(t: DataFrame, k: int = 0) -> DataFrame:
    return t.where(F.col("j") - F.col("i") <= k)


def triu(t: DataFrame, k: int = 0) -> DataFrame:
    return t.where(F.col("j") - F.col("i") >= k)


def diagonal(t: DataFrame, k: int = 0) -> DataFrame:
    return t.where(F.col("i") + k == F.col("j")).select("i", "v")


def diag(v: DataFrame, k: int = 0) -> DataFrame:
    """A matrix with a vector (i, v) on diagonal ``k``."""
    return v.select((F.col("i") - min(k, 0)).alias("i"), (F.col("i") + max(k, 0)).alias("j"), "v")


def trace(t: DataFrame) -> DataFrame:
    return diagonal(t).agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("v"))


def reshape(t: DataFrame, cols: int, new_cols: int) -> DataFrame:
    """Row-major index arithmetic."""
    at = F.col("i") * cols + F.col("j")
    return t.select(F.floor(at / new_cols).cast("long").alias("i"), (at % new_cols).cast("long").alias("j"), "v")


def flip(t: DataFrame, axis: str, n: int) -> DataFrame:
    return t.withColumn(axis, n - 1 - F.col(axis))


def roll(t: DataFrame, axis: str, k: int, n: int) -> DataFrame:
    return t.withColumn(axis, F.pmod(F.col(axis) + k, F.lit(n)))


def pad(t: DataFrame, axis: str, before: int) -> DataFrame:
    """Room before the cells; absent cells are 0."""
    return t.withColumn(axis, F.col(axis) + before)


def slice_axis(t: DataFrame, axis: str, start: int, stop: int, step: int = 1) -> DataFrame:
    inside = t.where((F.col(axis) >= start) & (F.col(axis) < stop) & ((F.col(axis) - start) % step == 0))
    return inside.withColumn(axis, F.floor((F.col(axis) - start) / step).cast("long"))


def concatenate(a: DataFrame, b: DataFrame, axis: str, size: int) -> DataFrame:
    return a.unionByName(b.withColumn(axis, F.col(axis) + size))


def nonzero(t: DataFrame) -> DataFrame:
    return t.where("v != 0").drop("v")


def reduce_axes(t: DataFrame, keep: Sequence[str], fold: str = "sum", size: int | None = None) -> DataFrame:
    """Over all axes but ``keep``: sum, mean, min, max, prod, var, std, any, all.

    ``size``: the cells of a group, if absent zeros are to count for a mean or variance.
    """
    x = F.col("v").cast("double")
    if size is not None and fold in ("mean", "var", "std"):
        mean = F.sum(x) / size
        v = F.sum(x * x) / size - mean * mean
        out = {"mean": mean, "var": v, "std": F.sqrt(F.greatest(v, F.lit(0.0)))}[fold]
    else:
        nan = F.max(F.isnan(x))
        out = {"sum": F.sum(x), "mean": F.avg(x), "min": F.when(nan, float("nan")).otherwise(F.min(x)), "max": F.max(x), "prod": F.product(x), "var": F.var_pop(x), "std": F.stddev_pop(x), "any": F.bool_or(x != 0), "all": F.bool_and(x != 0)}[fold]
    return (t.groupBy(*keep) if keep else t.groupBy()).agg(out.alias("v"))


def arg_extreme(t: DataFrame, keep: Sequence[str], axis: str, largest: bool = True) -> DataFrame:
    """The index of the extreme along an axis, the first of equals."""
    order = F.struct((-F.col("v") if largest else F.col("v")), F.col(axis))
    return t.groupBy(*keep).agg(F.min_by(axis, order).alias(axis))


def elementwise(a: DataFrame, b: DataFrame, axes: Sequence[str], f) -> DataFrame:
    """A function of two tensors' cells; an absent cell is 0."""
    joined = a.withColumnRenamed("v", "__a").join(b.withColumnRenamed("v", "__b"), list(axes), "full")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return joined.select(*axes, f(zero("__a"), zero("__b")).alias("v"))


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    return einsum("ij,jk->ik", a, b)


def outer(a: DataFrame, b: DataFrame) -> DataFrame:
    """Of vectors (i, v)."""
    right = b.select(F.col("i").alias("j"), F.col("v").alias("__b"))
    return a.crossJoin(right).select("i", "j", (F.col("v") * F.col("__b")).alias("v"))


def kron(a: DataFrame, b: DataFrame, rows_b: int, cols_b: int) -> DataFrame:
    right = b.select(F.col("i").alias("__i"), F.col("j").alias("__j"), F.col("v").alias("__b"))
    return a.crossJoin(right).select((F.col("i") * rows_b + F.col("__i")).alias("i"), (F.col("j") * cols_b + F.col("__j")).alias("j"), (F.col("v") * F.col("__b")).alias("v"))


def matrix_power(t: DataFrame, n: int, size: int) -> DataFrame:
    """By repeated squaring."""
    if n < 0:
        raise ValueError("negative power")
    out, base = None, t
    while n:
        if n & 1:
            out = base if out is None else matmul(out, base)
        n >>= 1
        base = matmul(base, base) if n else base
    return out if out is not None else eye(t.sparkSession, size)


def einsum(subscripts: str, *tensors: DataFrame) -> DataFrame:
    """Sums of products over shared letters, e.g. ``"ij,jk->ik"``.

    Tensors have one index column a letter, in order, and ``v``; the result has
    the output's letters. Operands are joined pairwise on the letters they share
    and summed as soon as a letter is needed no more, which keeps what is joined next small.
    Of three or more, the two whose joint rows are fewest by the letters' extents come next.
    """
    left, _, out = subscripts.replace(" ", "").partition("->")
    terms = left.split(",")
    if len(terms) != len(tensors):
        raise ValueError("one term a tensor is needed")
    if "->" not in subscripts:
        letters = "".join(terms)
        out = "".join(sorted(c for c in set(letters) if c.isalpha() and letters.count(c) == 1))
    named = []
    for term, t in zip(terms, tensors, strict=True):
        index = [c for c in t.columns if c != "v"]
        if len(index) != len(term):
            raise ValueError(f"{term} doesn't fit {index}")
        same = reduce(lambda a, b: a & b, (F.col(index[k]) == F.col(index[term.index(c)]) for k, c in enumerate(term) if term.index(c) != k), F.lit(True))
        named.append((list(dict.fromkeys(term)), t.where(same).select(*(F.col(index[term.index(c)]).alias(c) for c in dict.fromkeys(term)), "v")))
    sizes = _extents(named) if len(named) > 2 else {}
    while len(named) > 1:
        x, y = min(combinations(range(len(named)), 2), key=lambda p: _joint(named[p[0]][0], named[p[1]][0], sizes)) if len(named) > 2 else (0, 1)
        (letters, acc), (more, t) = named[x], named[y]
        shared = [c for c in letters if c in more]
        right = t.withColumnRenamed("v", "__b")
        acc = (acc.join(right, shared) if shared else acc.crossJoin(right)).withColumn("v", F.col("v") * F.col("__b")).drop("__b")
        letters = letters + [c for c in more if c not in letters]
        rest = [n for k, n in enumerate(named) if k not in (x, y)]
        keep = [c for c in letters if c in set(out).union(*(n for n, _ in rest))]
        if len(keep) < len(letters):
            acc, letters = _summed(acc, keep), keep
        if not rest:
            return acc.select(*out, "v")
        named = [(letters, acc), *rest]
    return _summed(named[0][1], list(out))


def _extents(named: list[tuple[list[str], DataFrame]]) -> dict[str, int]:
    """About how many values each letter has, for the order of joins only; a letter's first tensor counts."""
    sizes: dict[str, int] = {}
    for letters, t in named:
        if new := [c for c in letters if c not in sizes]:
            sizes |= t.agg(*(F.approx_count_distinct(c).alias(c) for c in new)).first().asDict()
    return sizes


def _joint(a: list[str], b: list[str], sizes: dict[str, int]) -> tuple[int, int]:
    """(products that a join makes if tensors are full, letters that only one of them has)."""
    return prod(max(1, sizes[c]) for c in {*a, *b}), len({*a} ^ {*b})


def _summed(t: DataFrame, keep: list[str]) -> DataFrame:
    total: Column = F.sum("v").alias("v")
    return t.groupBy(*keep).agg(total) if keep else t.agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("v"))


def norm(t: DataFrame, order: str = "fro") -> DataFrame:
    """Frobenius, or the largest column (1) or row (inf) sum of magnitudes."""
    if order == "fro":
        return t.agg(F.sqrt(F.coalesce(F.sum(F.col("v") * F.col("v")), F.lit(0.0))).alias("v"))
    sums = t.groupBy("j" if order == "1" else "i").agg(F.sum(F.abs("v")).alias("v"))
    return sums.agg(F.max("v").alias("v"))


# --- along an axis --------------------------------------------------------------


def _axes(t: DataFrame) -> list[str]:
    return [c for c in t.columns if c != "v"]


def take_along_axis(t: DataFrame, indices: DataFrame, axis: str) -> DataFrame:
    """For each cell of ``indices`` (the axes of ``t``; v is a position on ``axis``), the value of ``t`` there; positions without a value give no cell."""
    rest = [c for c in _axes(t) if c != axis]
    wanted = indices.withColumnRenamed("v", "__at")
    return wanted.join(t.withColumnRenamed(axis, "__at"), [*rest, "__at"]).select(*_axes(t), "v")


def put_along_axis(t: DataFrame, indices: DataFrame, values: DataFrame, axis: str) -> DataFrame:
    """``t`` with the cells of ``values`` written at the positions on ``axis`` that ``indices`` holds; of repeated positions the last on ``axis`` counts."""
    axes = _axes(t)
    rest = [c for c in axes if c != axis]
    cells = indices.withColumnRenamed("v", "__at").join(values, axes)
    new = cells.groupBy(*rest, "__at").agg(F.max_by("v", axis).alias("__new")).withColumnRenamed("__at", axis)
    joined = t.join(new.withColumn("__is", F.lit(True)), axes, "full")
    return joined.select(*axes, F.when(F.col("__is"), F.col("__new")).otherwise(F.col("v")).alias("v"))


def array_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row, ``equal``: whether both hold the same cells with the same values (NaN equals nothing, null only null)."""
    axes = _axes(a)
    both = a.withColumn("__a", F.lit(1)).join(b.withColumnRenamed("v", "w").withColumn("__b", F.lit(1)), axes, "full")
    number = (F.col("v") == F.col("w")) & ~F.isnan(F.col("v").cast("double"))
    same = F.col("__a").isNotNull() & F.col("__b").isNotNull() & F.coalesce(number, F.col("v").isNull() & F.col("w").isNull())
    return both.agg(F.coalesce(F.bool_and(same), F.lit(True)).alias("equal"))
