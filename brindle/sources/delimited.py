"""Delimited text as tables, with rules of its own for missing values and types.

Files are read by Spark as strings in parallel; types are inferred by one
aggregate over all rows, not from a sample.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What counts as missing, true and false (fixed values).
NA = ("", "NA", "N/A", "null", "NULL", "nan", "NaN")
TRUE = ("true", "t", "yes", "y", "1")
FALSE = ("false", "f", "no", "n", "0")
_SHORT = {"float32": T.FloatType(), "float64": T.DoubleType(), "int32": T.IntegerType(), "int64": T.LongType(), "bool": T.BooleanType(), "string": T.StringType()}


def _bool(x: Column) -> Column:
    low = F.lower(F.trim(x))
    return F.when(low.isin(*TRUE), True).when(low.isin(*FALSE), False)


def _parse(x: Column, kind: T.DataType) -> Column:
    """What can't be read as the type is null."""
    if isinstance(kind, T.StringType):
        return x
    return _bool(x) if isinstance(kind, T.BooleanType) else F.trim(x).try_cast(kind)


def infer(df: DataFrame, names: Sequence[str]) -> dict[str, T.DataType]:
    """bool, int32, int64, float64 or string for string columns: the first that fits all values."""
    order = (T.BooleanType(), T.IntegerType(), T.LongType(), T.DoubleType())
    tests = [F.count_if(F.col(f"`{n}`").isNotNull() & _parse(F.col(f"`{n}`"), k).isNull()).alias(f"{i}_{j}") for i, n in enumerate(names) for j, k in enumerate(order)]
    seen = [F.count(F.col(f"`{n}`")).alias(f"n{i}") for i, n in enumerate(names)]
    if not names:
        return {}
    row = df.agg(*tests, *seen).first()
    pick = lambda i: next((k for j, k in enumerate(order) if not row[f"{i}_{j}"]), T.StringType()) if row[f"n{i}"] else T.StringType()
    return {n: pick(i) for i, n in enumerate(names)}


def _typed(strings: DataFrame, na: Sequence[str], types: dict | None) -> DataFrame:
    clean = strings.select(*(F.when(~F.col(f"`{c}`").isin(*na), F.col(f"`{c}`")).alias(c) for c in strings.columns))
    given = {n: _SHORT.get(t, t) if isinstance(t, str) else t for n, t in (types or {}).items()}
    if unknown := set(given) - set(clean.columns):
        raise KeyError(f"no such column: {', '.join(sorted(unknown))}")
    kinds = infer(clean, [c for c in clean.columns if c not in given]) | given
    return clean.select(*(_parse(F.col(f"`{c}`"), kinds[c]).alias(c) for c in clean.columns))


def read_csv(spark: SparkSession, path: str, sep: str = ",", names: Sequence[str] | None = None, na: Sequence[str] = NA, types: dict | None = None) -> DataFrame:
    """A table of a file or folder; the first line names the columns unless ``names`` does. Rows that are too short or long raise."""
    head = spark.read.option("sep", sep).option("header", names is None).option("inferSchema", False).csv(path)
    columns = list(names) if names is not None else head.columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    strings = spark.read.schema(schema).option("sep", sep).option("header", names is None).option("mode", "FAILFAST").option("emptyValue", "").option("nullValue", "\u0000").option("enforceSchema", True).csv(path)
    return _typed(strings, na, types)


def parse_csv(spark: SparkSession, text: str, sep: str = ",", names: Sequence[str] | None = None, na: Sequence[str] = NA, types: dict | None = None) -> DataFrame:
    """A table of a small string."""
    import csv
    import io

    rows = [r for r in csv.reader(io.StringIO(text), delimiter=sep) if r]
    columns, rows = (list(names), rows) if names is not None else (rows[0], rows[1:])
    if any(len(r) != len(columns) for r in rows):
        raise ValueError("rows differ in length")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return _typed(spark.createDataFrame([tuple(r) for r in rows], schema), na, types)


def write_csv(df: DataFrame, path: str, sep: str = ",", na: str = "") -> None:
    df.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(na)).alias(c) for c in df.columns)).write.option("sep", sep).option("header", True).option("emptyValue", "").csv(path)


def csv_lines(df: DataFrame, sep: str = ",", na: str = "") -> DataFrame:
    """Rows as delimited text, one a row, without a header."""
    text = F.to_csv(F.struct(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(na)).alias(c) for c in df.columns)), {"sep": sep, "emptyValue": ""})
    return df.select(text.alias("value"))


def read_numbers(spark: SparkSession, path: str, sep: str | None = None, comments: str = "#", skip: int = 0, most: int | None = None) -> DataFrame:
    """(line, values): an array of doubles for each line of numbers; blanks and comments are passed over.

    ``skip`` and ``most`` count lines of a file, so they are for files that one task reads.
    """
    lines = spark.read.text(path).withColumn("line", F.monotonically_increasing_id())
    lines = lines.where(F.col("line") >= skip) if skip else lines
    bare = F.trim(F.split_part("value", F.lit(comments), F.lit(1))) if comments else F.trim("value")
    kept = lines.select("line", bare.alias("value")).where(F.length("value") > 0)
    kept = kept.orderBy("line").limit(most) if most is not None else kept
    parts = F.split("value", r"\s+" if sep is None else "".join("\\" + c if not c.isalnum() else c for c in sep))
    return kept.select("line", F.transform(parts, lambda x: F.trim(x).cast("double")).alias("values"))


def write_numbers(df: DataFrame, column: str, path: str, sep: str = " ") -> None:
    df.select(F.array_join(F.transform(column, lambda x: x.cast("string")), sep).alias("value")).write.text(path)
