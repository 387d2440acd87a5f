import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.operators import aggregates as A
from brindle.operators import frame as T
from brindle.operators import ordered
from brindle.operators import rowwise as R


def rows(df, *order):
    df = df.orderBy(*order) if order else df
    return [tuple(r) for r in df.collect()]


def test_create_checks_lengths(spark):
    t = T.create(spark, {"a": ("int32", [1, None, 3]), "b": ("string", ["x", "y", None])})
    assert T.column_types(t) == {"a": "int32", "b": "string"} and T.shape(t) == (3, 2)
    with pytest.raises(ValueError):
        T.create(spark, {"a": ("int32", [1]), "b": ("int32", [])})


def test_join_kinds_and_keys(spark):
    left = T.create(spark, {"key": ("string", ["a", "b", "c"]), "val1": ("int32", [1, 2, 3])})
    right = T.create(spark, {"key": ("string", ["b", "c", "d"]), "val2": ("int32", [20, 30, 40])})
    assert rows(T.join(left, right, "key"), "key") == [("b", 2, 20), ("c", 3, 30)]
    assert rows(T.join(left, right, "key", how="left"), "key") == [("a", 1, None), ("b", 2, 20), ("c", 3, 30)]
    assert rows(T.join(left, right, "key", how="right"), "key") == [("b", 2, 20), ("c", 3, 30), ("d", None, 40)]
    assert len(rows(T.join(left, right, "key", how="outer"))) == 4
    with pytest.raises(TypeError):
        T.join(left, right.withColumn("key", F.lit(1)), "key")


def test_join_nulls_and_suffixes(spark):
    left = T.create(spark, {"id": ("int32", [1, None]), "value": ("int32", [10, 20])})
    right = T.create(spark, {"id": ("int32", [1, None]), "value": ("int32", [100, 200])})
    got = T.join(left, right, "id", suffixes=("_left", "_right"))
    assert got.columns == ["id", "value_left", "value_right"] and rows(got) == [(1, 10, 100)]
    assert got.count() + 1 == T.join(left, right, "id", null_safe=True).count()


def test_pivot_and_melt(spark):
    t = T.create(spark, {"date": ("string", ["01", "01", "02", "02"]), "product": ("string", ["A", "B", "A", "B"]), "sales": ("float64", [100.0, 150.0, 120.0, 180.0])})
    assert rows(T.pivot(t, "date", "product", "sales"), "date") == [("01", 100.0, 150.0), ("02", 120.0, 180.0)]
    gap = T.pivot(t.where("not (date = '02' and product = 'B')"), "date", "product", "sales")
    assert math.isnan(rows(gap, "date")[1][2])
    wide = T.create(spark, {"id": ("int32", [1, 2]), "A": ("int32", [1, 2]), "B": ("int32", [3, 4]), "C": ("int32", [5, 6])})
    assert rows(T.melt(wide, ["id"]), "id", "variable") == [(1, "A", 1.0), (1, "B", 3.0), (1, "C", 5.0), (2, "A", 2.0), (2, "B", 4.0), (2, "C", 6.0)]


def test_nulls_are_not_nan(spark):
    t = T.create(spark, {"a": ("float64", [1.0, None, float("nan")]), "i": ("int32", [1, 2, 3])})
    assert T.drop_nulls(t).count() == 2
    assert [r[0] for r in rows(T.fill_null(t, "a", 0.0), "i")][:2] == [1.0, 0.0]
    with pytest.raises(TypeError):
        T.fill_null(t, "i", 0.5)
    with pytest.raises(KeyError):
        T.drop_nulls(t, ["absent"])


def test_row_reductions(spark):
    t = T.create(spark, {"f": ("float64", [1.0, None, 5.0]), "i": ("int32", [2, 3, None]), "base": ("int32", [10, 20, 30]), "s": ("string", ["x"] * 3)})
    c = ["f", "i", "base", "s"]
    assert rows(t.select(R.row_sum(t, c))) == [(13.0,), (23.0,), (35.0,)]
    strict = [r[0] for r in rows(t.select(R.row_sum(t, c, skipna=False)))]
    assert strict[0] == 13.0 and math.isnan(strict[1]) and math.isnan(strict[2])
    assert rows(t.select(R.row_min(t, c), R.row_max(t, c))) == [(1.0, 10.0), (3.0, 20.0), (5.0, 30.0)]
    assert rows(t.select(R.dot(t, ["f", "i"], [2.0, 1.0]))) == [(4.0,), (3.0,), (10.0,)]
    b = T.create(spark, {"a": ("bool", [True, True, False]), "b": ("bool", [True, None, False])})
    assert rows(b.select(R.row_all(["a", "b"]), R.row_any(["a", "b"]))) == [(True, True), (False, True), (False, False)]


def test_empty_aggregates(spark):
    t = T.create(spark, {"x": ("float64", []), "b": ("bool", [])})
    got = t.agg(A.sum_("x"), A.mean("x"), A.median("x"), A.min_("x"), A.count("x"), A.bool_all("b"), A.bool_any("b")).first()
    assert got[0] == 0.0 and math.isnan(got[1]) and math.isnan(got[2]) and got[3] is None and got[4:] == (0, True, False)


@pytest.mark.parametrize("size", [7, 1000])
def test_ranges_agree_with_one_window(spark, size):
    x = np.random.default_rng(1).integers(-5, 6, 97).astype(float).tolist()
    x[10] = None
    t = T.create(spark, {"i": ("int64", list(range(97))), "x": ("float64", x)})
    values = [0.0 if v is None else v for v in x]
    got = [r[2] for r in rows(ordered.running(t, "x", "sum", "i", name="s", rows_a_range=size), "i")]
    assert got == np.cumsum(values).tolist()
    assert [r[2] for r in rows(ordered.with_row_index(t, "i", rows_a_range=size), "i")] == list(range(97))
    lagged = ordered.framed(t, "i", 3, 0, lambda w: {"l": F.lag("x", 3).over(w)}, rows_a_range=size)
    assert [r[2] for r in rows(lagged, "i")] == [None] * 3 + x[:-3]


def test_running_min_keeps_nan(spark):
    t = T.create(spark, {"i": ("int64", [0, 1, 2, 3]), "x": ("float64", [3.0, 1.0, float("nan"), 2.0])})
    for size in (1, 2, 100):
        got = [r[2] for r in rows(ordered.running(t, "x", "min", "i", name="m", rows_a_range=size), "i")]
        assert got[:2] == [3.0, 1.0] and all(map(math.isnan, got[2:]))


def test_diff_pct_shift(spark):
    t = T.create(spark, {"i": ("int64", [0, 1, 2]), "x": ("float64", [1.0, 0.0, 5.0])})
    assert [r[1] for r in rows(T.diff(t, "x", "i"), "i")] == [0.0, -1.0, 5.0]
    pct = [r[1] for r in rows(T.pct_change(t, "x", "i"), "i")]
    assert math.isnan(pct[0]) and pct[1] == -1.0 and math.isnan(pct[2])
    assert [r[1] for r in rows(T.shift(t, "x", -1, "i"), "i")] == [0.0, 5.0, None]


def test_duplicates_take_sample(spark):
    t = T.create(spark, {"i": ("int64", list(range(6))), "k": ("string", ["a", "b", "a", None, None, "b"])})
    assert [r[0] for r in rows(T.drop_duplicates(t, "i", ["k"]), "i")] == [0, 1, 3]
    assert [r[0] for r in rows(T.take(t, [4, 0, 4], "i"), "position")] == [4, 0, 4]
    assert T.sample(t, "i", n=4, seed=1).count() == 4 and T.sample(t, "i", frac=0.5).count() == 3
    assert T.sample(t, "i", n=10, replace=True).count() == 10
    with pytest.raises(ValueError):
        T.sample(t, "i", n=7)


def test_sort_head_tail_slice(spark):
    t = T.create(spark, {"i": ("int64", [0, 1, 2, 3]), "x": ("float64", [2.0, None, 3.0, 1.0])})
    assert [r[0] for r in T.sort_values(t, "x").collect()] == [3, 0, 2, 1]
    assert [r[0] for r in T.sort_values(t, "x", False).collect()] == [2, 0, 3, 1]
    assert [r[0] for r in T.tail(t, "i", 2).collect()] == [2, 3]
    assert [r[0] for r in T.slice_rows(t, 1, 99, "i").collect()] == [1, 2, 3]


def test_concat_describe_display(spark):
    t = T.create(spark, {"a": ("int32", [1, 2, 3, 4])})
    assert T.concat_rows([t, t]).count() == 8
    with pytest.raises(ValueError):
        T.concat_rows([t, t.withColumnRenamed("a", "b")])
    got = T.describe(t).first()
    assert (got["count"], got["mean"], got["50%"], got["max"]) == (4, 2.5, 2.5, 4.0)
    assert "<td>1</td>" in T.to_html(t) and "a" in T.to_string(t)
    assert rows(T.info(t)) == [("a", "int32", 0)]


def test_ranges_are_cut_by_the_whole_key(spark):
    """A first column of two values, strings and nulls: many ranges, one order."""
    from brindle.operators import ordered

    rows = [(i % 2, None if i % 11 == 0 else f"s{i * 7919 % 1000:03}", i) for i in range(1000)]
    t = spark.createDataFrame(rows, "a int, b string, c int")
    ranged = ordered.with_ranges(t, ["a", "b", "c"], 50)
    sizes = [r["count"] for r in ranged.groupBy("__range").count().collect()]
    assert len(sizes) > 15 and max(sizes) < 200
    got = {r["c"]: r["at"] for r in ordered.with_row_index(t, ["a", "b", "c"], "at", 50).collect()}
    want = sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or "", r[2]))
    assert got == {r[2]: i for i, r in enumerate(want)}
