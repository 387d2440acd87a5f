"""Table operators: DataFrame in, DataFrame out.

Order-sensitive operators take ``order_by``; Spark tables have no row order of
their own. Null and NaN are different things throughout: null is a missing
value, NaN a number.
"""

from __future__ import annotations

import html as _html
from collections.abc import Iterable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import ordered

FLOATS = (T.FloatType, T.DoubleType)
INTS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_CLASSES = {"numeric": (*FLOATS, *INTS, T.DecimalType), "float": FLOATS, "int": INTS, "bool": (T.BooleanType,), "string": (T.StringType,)}
_SHORT = {"float32": T.FloatType(), "float64": T.DoubleType(), "int32": T.IntegerType(), "int64": T.LongType(), "bool": T.BooleanType(), "string": T.StringType()}


# --- making and reading -------------------------------------------------------


def create(spark: SparkSession, columns: dict[str, tuple[str | T.DataType, Sequence]]) -> DataFrame:
    """A table from name: (type, values); None is null. Columns must be equally long."""
    sizes = {len(v) for _, v in columns.values()}
    if len(sizes) > 1:
        raise ValueError(f"columns differ in length: {sorted(sizes)}")
    schema = T.StructType([T.StructField(n, _SHORT.get(t, t) if isinstance(t, str) else t) for n, (t, _) in columns.items()])
    return spark.createDataFrame(list(zip(*(v for _, v in columns.values()), strict=True)), schema)


def from_arrays(spark: SparkSession, arrays: Sequence[np.ndarray] | np.ndarray, names: Sequence[str] | None = None) -> DataFrame:
    """A table from 1-D arrays of one length, or from the columns of a 2-D array; names default to col0, col1, ..."""
    if isinstance(arrays, np.ndarray):
        if arrays.ndim != 2:
            raise ValueError("a two-dimensional array is needed")
        arrays = list(arrays.T)
    names = list(names) if names is not None else [f"col{i}" for i in range(len(arrays))]
    if len(names) != len(arrays) or len(set(names)) != len(names):
        raise ValueError("one distinct name a column is needed")
    if any(a.ndim != 1 for a in arrays) or len({len(a) for a in arrays}) > 1:
        raise ValueError("one-dimensional arrays of one length are needed")
    return spark.createDataFrame(pd.DataFrame(dict(zip(names, arrays, strict=True))))


def to_numpy(df: DataFrame) -> np.ndarray:
    """The numeric columns as a float32 matrix, null as NaN (on the driver)."""
    return df.select(*select_columns(df, "numeric")).toPandas().to_numpy(dtype="float32", na_value=np.nan)


def column_values(df: DataFrame, name: str, order_by: str | Sequence[str] | None = None) -> list:
    """A column's values, null as None (on the driver)."""
    df = df.orderBy(order_by) if order_by is not None else df
    return [r[0] for r in df.select(name).collect()]


def shape(df: DataFrame) -> tuple[int, int]:
    return df.count(), len(df.columns)


def column_types(df: DataFrame) -> dict[str, str]:
    """Each column's type: float32, float64, int32, int64, bool, string or other."""
    names = {type(t): n for n, t in _SHORT.items()}
    return {f.name: names.get(type(f.dataType), "other") for f in df.schema}


# --- columns ------------------------------------------------------------------


def _known(df: DataFrame, names: Iterable[str]) -> list[str]:
    names = list(names)
    if missing := [n for n in names if n not in df.columns]:
        raise KeyError(f"no such column: {', '.join(missing)}")
    return names


def select_columns(df: DataFrame, kind: str) -> list[str]:
    """Names of the columns of a kind: numeric, float, int, bool or string."""
    return [f.name for f in df.schema if isinstance(f.dataType, _CLASSES[kind])]


def select(df: DataFrame, names: Sequence[str], strict: bool = True) -> DataFrame:
    return df.select(*(_known(df, names) if strict else [n for n in names if n in df.columns]))


def reorder_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The named columns first, the others after them."""
    return df.select(*_known(df, names), *(c for c in df.columns if c not in names))


def add_column(df: DataFrame, name: str, value: Column) -> DataFrame:
    """With a column at the end, also if one of its name stood elsewhere."""
    return df.select(*(F.col(c) for c in df.columns if c != name), value.alias(name))


def drop_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.drop(*names)


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    _known(df, [old])
    if new != old and new in df.columns:
        raise ValueError(f"column {new} is there already")
    return df.withColumnRenamed(old, new)


def cast_column(df: DataFrame, name: str, kind: str | T.DataType) -> DataFrame:
    return df.withColumn(name, F.col(name).cast(_SHORT.get(kind, kind) if isinstance(kind, str) else kind))


def with_columns(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return df.withColumns(columns)


# --- rows ---------------------------------------------------------------------


def head(df: DataFrame, order_by: str | Sequence[str], n: int = 5) -> DataFrame:
    return df.orderBy(order_by).limit(n)


def tail(df: DataFrame, order_by: str | Sequence[str], n: int = 5) -> DataFrame:
    """The last ``n`` rows; each task keeps ``n`` at most."""
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    return df.orderBy(*(F.col(c).desc_nulls_last() for c in keys)).limit(n).orderBy(*keys)


def slice_rows(df: DataFrame, start: int, stop: int, order_by: str | Sequence[str]) -> DataFrame:
    """Rows ``start`` to ``stop`` (exclusive) in order, clamped to what there is."""
    start = max(0, start)
    return df.orderBy(order_by).offset(start).limit(max(0, stop - start))


def take(df: DataFrame, indices: Sequence[int], order_by: str | Sequence[str]) -> DataFrame:
    """The rows at positions of the order, as often and in the sequence that they are asked for (column ``position``)."""
    spark = df.sparkSession
    wanted = spark.createDataFrame([(int(i), p) for p, i in enumerate(indices)], "__i long, position long")
    return ordered.with_row_index(df, order_by, "__i").join(F.broadcast(wanted), "__i").drop("__i")


def sample(df: DataFrame, key: str | Sequence[str], n: int | None = None, frac: float | None = None, replace: bool = False, seed: int = 0) -> DataFrame:
    """Exactly ``n`` rows, or the floor of a fraction of all, chosen by a hash of a unique key and the seed."""
    keys = [key] if isinstance(key, str) else list(key)
    if (n is None) == (frac is None):
        raise ValueError("either n or frac is needed")
    total = df.count() if frac is not None or replace or n is not None else 0
    n = int(np.floor(frac * total)) if n is None else n
    if replace:
        if n and not total:
            raise ValueError("there is nothing to draw from")
        drawn = df.sparkSession.range(n).select(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(total, 1))).alias("__i"))
        return ordered.with_row_index(df, keys, "__i").join(drawn, "__i").drop("__i")
    if n > total:
        raise ValueError(f"{n} rows are asked for, there are {total}")
    return df.orderBy(F.xxhash64(*keys, F.lit(seed)), *keys).limit(n)


def filter_mask(df: DataFrame, mask: DataFrame, order_by: str | Sequence[str], mask_order: str | Sequence[str], mask_col: str) -> DataFrame:
    """The rows at whose position the mask table's row is true."""
    on = ordered.with_row_index(mask, mask_order, "__i").where(F.col(mask_col)).select("__i")
    return ordered.with_row_index(df, order_by, "__i").join(on, "__i", "left_semi").drop("__i")


def drop_nulls(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Rows without null in the subset; NaN stays (Spark's ``dropna`` drops it)."""
    names = df.columns if subset is None else _known(df, subset)
    return df.where(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in names), F.lit(True)))


def fill_null(df: DataFrame, name: str, value) -> DataFrame:
    """Null replaced by a value of the column's kind; NaN stays."""
    kind = df.schema[_known(df, [name])[0]].dataType
    fits = isinstance(value, bool) if isinstance(kind, T.BooleanType) else isinstance(value, str) if isinstance(kind, T.StringType) else isinstance(value, int) and not isinstance(value, bool) if isinstance(kind, INTS) else isinstance(value, (int, float)) and not isinstance(value, bool)
    if not fits:
        raise TypeError(f"{value!r} doesn't fit {kind.simpleString()}")
    return df.withColumn(name, F.coalesce(F.col(name), F.lit(value).cast(kind)))


def null_count(df: DataFrame) -> DataFrame:
    """One row: the nulls of every column."""
    return df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in df.columns))


def drop_duplicates(df: DataFrame, order_by: str | Sequence[str], subset: Sequence[str] | None = None) -> DataFrame:
    """The first row, in order, of each set of equal values.

    A grouped minimum over structs: with map-side combine, a common value isn't
    gathered in one task, as a ranking window would.
    """
    keys = df.columns if subset is None else _known(df, subset)
    names = [order_by] if isinstance(order_by, str) else list(order_by)
    rest = [c for c in df.columns if c not in keys and c not in names]
    if any(isinstance(df.schema[c].dataType, T.MapType) for c in rest):
        ranked = F.row_number().over(Window.partitionBy(*keys).orderBy(*names))
        return df.withColumn("__n", ranked).where("__n = 1").drop("__n")
    row = F.min(F.struct(*(F.col(c).alias(f"o{i}") for i, c in enumerate(names)), F.struct(*df.columns).alias("row")))
    return df.groupBy(*(F.col(c).alias(f"__k{i}") for i, c in enumerate(keys))).agg(row.alias("__m")).select("__m.row.*")


def concat_rows(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows; names and their order must agree, types are those of the first."""
    if not frames:
        raise ValueError("nothing to put together")
    first = frames[0]
    if any(f.columns != first.columns for f in frames):
        raise ValueError("column names differ")
    return reduce(DataFrame.unionByName, (f.select(*(F.col(c).cast(first.schema[c].dataType).alias(c) for c in first.columns)) for f in frames))


def concat_columns(frames: Sequence[DataFrame], order_by: Sequence[str | Sequence[str]]) -> DataFrame:
    """Tables of equal length side by side, in their orders; names must be distinct."""
    names = [c for f in frames for c in f.columns]
    if len(set(names)) != len(names):
        raise ValueError("column names repeat")
    if len({f.count() for f in frames}) > 1:
        raise ValueError("tables differ in length")
    parts = [ordered.with_row_index(f, o, "__i") for f, o in zip(frames, order_by, strict=True)]
    return reduce(lambda a, b: a.join(b, "__i"), parts).drop("__i")


def sort_values(df: DataFrame, name: str, ascending: bool = True, then: Sequence[str] = ()) -> DataFrame:
    """By a column, nulls last either way; ``then`` breaks ties."""
    c = F.col(name)
    return df.orderBy(c.asc_nulls_last() if ascending else c.desc_nulls_last(), *then)


def value_counts(df: DataFrame, name: str) -> DataFrame:
    """(value, count) of the non-null values, most frequent first, then by value."""
    found = df.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("value")).agg(F.count("*").cast("int").alias("count"))
    return found.orderBy(F.desc("count"), "value")


# --- running and offset columns ----------------------------------------------


def cumsum(df: DataFrame, name: str, order_by: str | Sequence[str], partition_by: Sequence[str] = (), out: str | None = None) -> DataFrame:
    return ordered.running(df, name, "sum", order_by, partition_by, out)


def cumprod(df: DataFrame, name: str, order_by: str | Sequence[str], partition_by: Sequence[str] = (), out: str | None = None) -> DataFrame:
    return ordered.running(df, name, "product", order_by, partition_by, out)


def cummax(df: DataFrame, name: str, order_by: str | Sequence[str], partition_by: Sequence[str] = (), out: str | None = None) -> DataFrame:
    return ordered.running(df, name, "max", order_by, partition_by, out)


def cummin(df: DataFrame, name: str, order_by: str | Sequence[str], partition_by: Sequence[str] = (), out: str | None = None) -> DataFrame:
    return ordered.running(df, name, "min", order_by, partition_by, out)


def shift(df: DataFrame, name: str, periods: int, order_by: str | Sequence[str], partition_by: Sequence[str] = (), out: str | None = None) -> DataFrame:
    """The value ``periods`` rows earlier (later if negative), null beyond the ends."""
    make = lambda w: {out or name: (F.lag(name, periods) if periods >= 0 else F.lead(name, -periods)).over(w)}
    return ordered.framed(df, order_by, max(periods, 0), max(-periods, 0), make, partition_by)


def diff(df: DataFrame, name: str, order_by: str | Sequence[str], periods: int = 1, partition_by: Sequence[str] = (), out: str | None = None) -> DataFrame:
    """The change over ``periods`` rows; 0 where there is no earlier row."""
    kind = df.schema[name].dataType

    def make(w):
        before = F.lag(name, periods).over(w)
        there = F.lag(F.lit(1), periods).over(w)
        return {out or name: F.when(there.isNull() & F.col(name).isNotNull(), F.lit(0)).otherwise(F.col(name) - before).cast(kind)}

    return ordered.framed(df, order_by, periods, 0, make, partition_by)


def pct_change(df: DataFrame, name: str, order_by: str | Sequence[str], periods: int = 1, partition_by: Sequence[str] = (), out: str | None = None) -> DataFrame:
    """The relative change over ``periods`` rows; NaN where there is no earlier value or it is 0."""

    def make(w):
        before = F.lag(F.col(name).cast("double"), periods).over(w)
        change = F.try_divide(F.col(name).cast("double") - before, before)
        return {out or name: F.when(before.isNull() | (before == 0), float("nan")).otherwise(change)}

    return ordered.framed(df, order_by, periods, 0, make, partition_by)


# --- two tables, and shapes ---------------------------------------------------


def join(left: DataFrame, right: DataFrame, on: str, right_on: str | None = None, how: str = "inner", suffixes: tuple[str, str] = ("_x", "_y"), null_safe: bool = False) -> DataFrame:
    """Equi-join on a key: inner, left, right or outer.

    The key comes out once, from whichever side has it. Other names that both
    sides have get the suffixes. Null keys match nothing unless ``null_safe``.
    """
    right_on = right_on or on
    _known(left, [on])
    _known(right, [right_on])
    lt, rt = left.schema[on].dataType, right.schema[right_on].dataType
    if lt != rt and not (isinstance(lt, _CLASSES["int"]) and isinstance(rt, _CLASSES["int"])):
        raise TypeError(f"keys differ in type: {lt.simpleString()} and {rt.simpleString()}")
    shared = (set(left.columns) - {on}) & (set(right.columns) - {right_on})
    ls = left.select(F.col(on).alias("__l"), *(F.col(c).alias(c + suffixes[0] if c in shared else c) for c in left.columns if c != on))
    rs = right.select(F.col(right_on).alias("__r"), *(F.col(c).alias(c + suffixes[1] if c in shared else c) for c in right.columns if c != right_on))
    match = F.col("__l").eqNullSafe(F.col("__r")) if null_safe else F.col("__l") == F.col("__r")
    out = ls.join(rs, match, {"outer": "full"}.get(how, how))
    return out.select(F.coalesce("__l", "__r").alias(on), *(c for c in ls.columns if c != "__l"), *(c for c in rs.columns if c != "__r"))


_FOLDS = {"sum": F.sum, "mean": F.avg, "count": F.count, "min": F.min, "max": F.max}


def pivot(df: DataFrame, index: str, columns: str, values: str, agg: str = "sum", order_by: str | None = None, names: Sequence | None = None) -> DataFrame:
    """One row per index value (as string), one column per value of ``columns``.

    Columns are in the order of first appearance by ``order_by``, else sorted;
    give ``names`` to spare the pass that finds them. Cells without rows are NaN.
    """
    if names is None:
        seen = df.where(F.col(columns).isNotNull()).groupBy(F.col(columns).alias("c")).agg(F.min(order_by or columns).alias("o")).orderBy("o", "c")
        names = [r["c"] for r in seen.select("c").collect()]  # column names: as few as a table can have columns
    cell = _FOLDS[agg](F.col(values).cast("double")).cast("double")
    wide = df.groupBy(F.col(index).cast("string").alias(index)).pivot(columns, list(names)).agg(cell)
    return wide.select(index, *(F.coalesce(F.col(f"`{c}`"), F.lit(float("nan"))).alias(str(c)) for c in wide.columns if c != index))


def melt(df: DataFrame, id_vars: Sequence[str] = (), value_vars: Sequence[str] | None = None, var_name: str = "variable", value_name: str = "value") -> DataFrame:
    """One row per row and value column; values as double."""
    value_vars = [c for c in df.columns if c not in id_vars] if value_vars is None else _known(df, value_vars)
    numbers = df.select(*_known(df, id_vars), *(F.col(c).cast("double").alias(c) for c in value_vars))
    return numbers.unpivot(list(id_vars), value_vars, var_name, value_name)


def describe(df: DataFrame) -> DataFrame:
    """(column, count, mean, std, min, 25%, 50%, 75%, max) of each numeric column, exact, in one pass and a re-shape."""
    names = select_columns(df, "numeric")

    def stats(c: str) -> Column:
        x = F.col(c).cast("double")
        q = F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        nan = F.lit(float("nan"))
        return F.struct(F.lit(c).alias("column"), F.count(x).alias("count"), F.coalesce(F.avg(x), nan).alias("mean"), F.coalesce(F.stddev_pop(x), nan).alias("std"), F.min(x).alias("min"), F.coalesce(q[0], nan).alias("25%"), F.coalesce(q[1], nan).alias("50%"), F.coalesce(q[2], nan).alias("75%"), F.max(x).alias("max"))

    return df.agg(F.array(*map(stats, names)).alias("s")).select(F.explode("s").alias("s")).select("s.*")


def group_frames(df: DataFrame, keys: Sequence[str], function, schema) -> DataFrame:
    """A Python function on each group's rows as a pandas frame; built-in aggregates are faster where they will do."""
    return df.groupBy(*keys).applyInPandas(function, schema)


# --- display ------------------------------------------------------------------


def to_string(df: DataFrame, max_rows: int = 10, max_cols: int = 10) -> str:
    """The first rows and columns as text."""
    names = df.columns[:max_cols]
    rows = df.select(*names).limit(max_rows).toPandas()
    more = f"\n[{len(df.columns)} columns]" if len(df.columns) > max_cols else ""
    return rows.to_string(index=False, na_rep="<null>") + more


def to_html(df: DataFrame, max_rows: int = 10, max_cols: int = 10) -> str:
    """The first rows and columns as an HTML table."""
    names = df.columns[:max_cols]
    cells = lambda tag, values: "".join(f"<{tag}>{_html.escape('<null>' if v is None else str(v))}</{tag}>" for v in values)
    body = "".join(f"<tr>{cells('td', r)}</tr>" for r in df.select(*names).limit(max_rows).collect())
    return f"<table><thead><tr>{cells('th', names)}</tr></thead><tbody>{body}</tbody></table>"


def info(df: DataFrame) -> DataFrame:
    """(column, type, nulls): a table about the table."""
    kinds = column_types(df)
    counted = df.agg(F.array(*(F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("type"), F.count_if(F.col(c).isNull()).alias("nulls")) for c in df.columns)).alias("s"))
    return counted.select(F.explode("s").alias("s")).select("s.*")
