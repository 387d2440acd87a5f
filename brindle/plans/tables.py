"""Queries of the table operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import frame as T
from ..operators import rowwise as R
from .registry import query, table


@query(
    "filter_high_value",
    """SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice), 4) AS total, count(*) AS n,
              round(avg(l_extendedprice), 4) AS mean, round(stddev_pop(l_extendedprice), 4) AS std
       FROM lineitem WHERE l_extendedprice > 1200 AND l_quantity >= 3 AND l_returnflag = 'R' GROUP BY ALL""",
)
def filter_high_value(spark, d):
    t = table(spark, d, "lineitem").where("l_extendedprice > 1200 and l_quantity >= 3 and l_returnflag = 'R'")
    x = F.col("l_extendedprice")
    return t.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum(x), 4).alias("total"), F.count("*").alias("n"), F.round(F.avg(x), 4).alias("mean"), F.round(F.stddev_pop(x), 4).alias("std"))


@query("group_flag_status", "SELECT concat(l_returnflag, '|', l_linestatus) AS k, round(sum(l_extendedprice), 2) AS total, count(*) AS n, round(avg(l_discount), 6) AS mean_discount FROM lineitem GROUP BY 1")
def group_flag_status(spark, d):
    t = table(spark, d, "lineitem")
    return t.groupBy(F.concat_ws("|", "l_returnflag", "l_linestatus").alias("k")).agg(F.round(A.sum_("l_extendedprice"), 2).alias("total"), A.count("l_extendedprice").alias("n"), F.round(A.mean("l_discount"), 6).alias("mean_discount"))


@query(
    "agg_all_numeric",
    """SELECT o_orderstatus, round(sum(o_totalprice), 2) AS s, round(avg(o_totalprice), 4) AS m, round(var_pop(o_totalprice), 2) AS v, round(stddev_pop(o_totalprice), 4) AS sd,
       min(o_totalprice) AS lo, max(o_totalprice) AS hi, round(median(o_totalprice), 4) AS med, round(quantile_cont(o_totalprice, 0.9), 4) AS q90,
       count(o_totalprice) AS n, count(DISTINCT o_custkey) AS u FROM orders GROUP BY 1""",
)
def agg_all_numeric(spark, d):
    x = "o_totalprice"
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(
        F.round(A.sum_(x), 2).alias("s"), F.round(A.mean(x), 4).alias("m"), F.round(A.var(x), 2).alias("v"), F.round(A.std(x), 4).alias("sd"), A.min_(x).alias("lo"), A.max_(x).alias("hi"),
        F.round(A.median(x), 4).alias("med"), F.round(A.quantile(x, 0.9), 4).alias("q90"), A.count(x).alias("n"), A.nunique("o_custkey").alias("u"),
    )


@query("agg_empty", "SELECT 0.0::DOUBLE AS s, 'NaN'::DOUBLE AS m, 'NaN'::DOUBLE AS sd, NULL::DOUBLE AS lo, 0::BIGINT AS n FROM (SELECT 1)")
def agg_empty(spark, d):
    x = "o_totalprice"
    return table(spark, d, "orders").where("o_orderkey < 0").agg(A.sum_(x).alias("s"), A.mean(x).alias("m"), A.std(x).alias("sd"), A.min_(x).alias("lo"), A.count(x).alias("n"))


@query("agg_string", "SELECT n_regionkey, min(n_name) AS lo, max(n_name) AS hi, string_agg(n_name, ',' ORDER BY n_nationkey) AS joined, count(DISTINCT n_name) AS u, list_sort(list(DISTINCT n_name)) AS names FROM nation GROUP BY 1")
def agg_string(spark, d):
    c = "n_name"
    return table(spark, d, "nation").groupBy("n_regionkey").agg(A.str_min(c).alias("lo"), A.str_max(c).alias("hi"), A.str_concat(c, "n_nationkey", ",").alias("joined"), A.str_nunique(c).alias("u"), A.str_unique(c).alias("names"))


@query("agg_string_mode", "SELECT value AS mode FROM (SELECT event_type AS value, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, value LIMIT 1)")
def agg_string_mode(spark, d):
    return table(spark, d, "events").agg(A.str_mode("event_type").alias("mode"))


@query("agg_bool", "SELECT l_returnflag, bool_and(l_discount > 0.05) AS al, bool_or(l_discount > 0.05) AS an, count(*) FILTER (l_discount > 0.05) AS s, round(avg((l_discount > 0.05)::INT), 6) AS m FROM lineitem GROUP BY 1")
def agg_bool(spark, d):
    b = F.col("l_discount") > 0.05
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(A.bool_all(b).alias("al"), A.bool_any(b).alias("an"), A.bool_sum(b).alias("s"), F.round(A.bool_mean(b), 6).alias("m"))


@query(
    "row_reduce",
    """SELECT l_orderkey, l_linenumber, round(l_quantity + l_discount + l_tax, 6) AS s, round((l_quantity + l_discount + l_tax) / 3, 6) AS m,
       least(l_quantity, l_discount, l_tax) AS lo, greatest(l_quantity, l_discount, l_tax) AS hi, round(2 * l_quantity - l_discount + 0.5 * l_tax, 6) AS d FROM lineitem""",
)
def row_reduce(spark, d):
    t, c = table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"]
    return t.select("l_orderkey", "l_linenumber", F.round(R.row_sum(t, c), 6).alias("s"), F.round(R.row_mean(t, c), 6).alias("m"), R.row_min(t, c).alias("lo"), R.row_max(t, c).alias("hi"), F.round(R.dot(t, c, [2, -1, 0.5]), 6).alias("d"))


@query("row_bool", "SELECT l_orderkey, l_linenumber, l_discount > 0.05 AND l_tax > 0.02 AS al, l_discount > 0.05 OR l_tax > 0.02 AS an FROM lineitem")
def row_bool(spark, d):
    t = T.with_columns(table(spark, d, "lineitem"), {"a": F.col("l_discount") > 0.05, "b": F.col("l_tax") > 0.02})
    return t.select("l_orderkey", "l_linenumber", R.row_all(["a", "b"]).alias("al"), R.row_any(["a", "b"]).alias("an"))


@query("select_types", "SELECT p_partkey, p_size, p_retailprice FROM part")
def select_types(spark, d):
    t = table(spark, d, "part")
    return T.select(t, T.select_columns(t, "numeric"))


@query("drop_rename_reorder_cast", "SELECT p_size::BIGINT AS size, p_partkey, p_name, p_brand, p_retailprice FROM part")
def drop_rename_reorder_cast(spark, d):
    t = T.rename_column(T.drop_columns(table(spark, d, "part"), ["p_type", "absent"]), "p_size", "size")
    return T.cast_column(T.reorder_columns(t, ["size"]), "size", "int64")


@query("with_columns", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net, concat(l_returnflag, '-', l_linestatus) AS code, l_quantity > 25 AS bulk FROM lineitem")
def with_columns(spark, d):
    t = T.with_columns(table(spark, d, "lineitem"), {"net": F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4), "code": F.concat_ws("-", "l_returnflag", "l_linestatus"), "bulk": F.col("l_quantity") > 25})
    return t.select("l_orderkey", "l_linenumber", "net", "code", "bulk")


@query("add_column_moves", "SELECT n_nationkey, n_regionkey, upper(n_name) AS n_name FROM nation")
def add_column_moves(spark, d):
    return T.add_column(table(spark, d, "nation"), "n_name", F.upper("n_name"))


@query("head_topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def head_topk(spark, d):
    t = table(spark, d, "orders").withColumn("k", -F.col("o_totalprice"))
    return T.head(t, ["k", "o_orderkey"], 20).select("o_orderkey", "o_totalprice")


@query("tail", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 7")
def tail(spark, d):
    return T.tail(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 7)


@query("slice_rows", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 25 OFFSET 10")
def slice_rows(spark, d):
    return T.slice_rows(table(spark, d, "orders").select("o_orderkey"), 10, 35, "o_orderkey")


@query("take_indices", "SELECT i AS position, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS rn FROM orders) JOIN (VALUES (0, 5), (1, 3), (2, 5), (3, 0)) AS w(i, j) ON rn = j")
def take_indices(spark, d):
    t = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return T.take(t, [5, 3, 5, 0], "o_orderkey").withColumn("position", F.col("position").cast("int"))


@query("filter_mask", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 3 = 0")
def filter_mask(spark, d):
    t = table(spark, d, "nation").select("n_nationkey", "n_name")
    mask = t.select("n_nationkey", (F.col("n_nationkey") % 3 == 0).alias("m"))
    return T.filter_mask(t, mask, "n_nationkey", "n_nationkey", "m")


@query("drop_nulls", "SELECT event_id, event_type, nullif(event_type, 'view') AS e FROM events WHERE event_type <> 'view'")
def drop_nulls(spark, d):
    t = table(spark, d, "events").select("event_id", "event_type", F.nullif("event_type", F.lit("view")).alias("e"))
    return T.drop_nulls(t, ["e"])


@query("fill_null", "SELECT event_id, coalesce(nullif(event_type, 'view'), 'none') AS e FROM events")
def fill_null(spark, d):
    return T.fill_null(table(spark, d, "events").select("event_id", F.nullif("event_type", F.lit("view")).alias("e")), "e", "none")


@query("null_count", "SELECT 0::BIGINT AS event_id, count(*) FILTER (event_type = 'view') AS e FROM events")
def null_count(spark, d):
    return T.null_count(table(spark, d, "events").select("event_id", F.nullif("event_type", F.lit("view")).alias("e")))


@query("drop_duplicates", "SELECT event_id, user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events) WHERE n = 1")
def drop_duplicates(spark, d):
    return T.drop_duplicates(table(spark, d, "events").select("event_id", "user_id", "event_type", "value"), "event_id", ["user_id", "event_type"])


@query("value_counts", "SELECT event_type AS value, count(*)::INT AS count FROM events GROUP BY 1")
def value_counts(spark, d):
    return T.value_counts(table(spark, d, "events"), "event_type")


@query("concat_rows", "SELECT n_nationkey AS k, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
def concat_rows(spark, d):
    return T.concat_rows([table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")), table(spark, d, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"))])


@query("concat_columns", "SELECT r_regionkey, r_name, n_nationkey, n_name FROM region JOIN nation ON n_nationkey = r_regionkey + 5")
def concat_columns(spark, d):
    n = table(spark, d, "nation").where("n_nationkey between 5 and 9").select("n_nationkey", "n_name")
    return T.concat_columns([table(spark, d, "region"), n], ["r_regionkey", "n_nationkey"])


def _join(name: str, how: str, sql: str) -> None:
    @query(f"join_{name}_whole", f"SELECT coalesce(c_custkey, o_custkey) AS c_custkey, c_name, o_orderkey, o_totalprice FROM customer {sql} orders ON c_custkey = o_custkey")
    def g(spark, d):
        c = table(spark, d, "customer").select("c_custkey", "c_name")
        return T.join(c, table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "c_custkey", "o_custkey", how)


for _name, _how, _sql in (("inner", "inner", "JOIN"), ("left", "left", "LEFT JOIN"), ("right", "right", "RIGHT JOIN"), ("outer", "outer", "FULL JOIN")):
    _join(_name, _how, _sql)


@query("join_suffixes", "SELECT a.n_nationkey, a.n_name AS n_name_left, a.n_regionkey AS n_regionkey_left, b.n_name AS n_name_right, b.n_regionkey AS n_regionkey_right FROM nation a JOIN nation b ON a.n_nationkey = b.n_nationkey")
def join_suffixes(spark, d):
    t = table(spark, d, "nation")
    return T.join(t, t, "n_nationkey", suffixes=("_left", "_right"))


@query("join_aggregate", "SELECT c_mktsegment, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def join_aggregate(spark, d):
    t = T.join(table(spark, d, "orders").select("o_custkey", "o_totalprice"), table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "o_custkey", "c_custkey")
    return t.groupBy("c_mktsegment").agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.count("*").alias("n"))


_PRIORITIES = "SELECT o_orderstatus, o_orderpriority, o_totalprice FROM orders"


def _pivot(agg: str, sql: str) -> None:
    cells = ", ".join(f"coalesce(round({sql} FILTER (o_orderstatus = '{s}'), 2), 'NaN'::DOUBLE) AS {s}" for s in ("F", "O", "P"))

    @query(f"pivot_{agg}", f"SELECT o_orderpriority, {cells} FROM orders GROUP BY 1" if agg != "count" else f"SELECT o_orderpriority, {', '.join(f"nullif(count(*) FILTER (o_orderstatus = '{s}'), 0)::DOUBLE AS {s}" for s in ('F', 'O', 'P'))} FROM orders GROUP BY 1")
    def f(spark, d):
        t = T.pivot(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", "o_totalprice", agg, names=["F", "O", "P"])
        return t.select("o_orderpriority", *(F.round(c, 2).alias(c) for c in ("F", "O", "P")))


for _agg, _sql in (("sum", "sum(o_totalprice)"), ("mean", "avg(o_totalprice)"), ("count", ""), ("min", "min(o_totalprice)"), ("max", "max(o_totalprice)")):
    _pivot(_agg, _sql)


@query("pivot_numeric_index", "SELECT l_linenumber::VARCHAR AS l_linenumber, coalesce(round(sum(l_quantity) FILTER (l_returnflag = 'A'), 2), 'NaN'::DOUBLE) AS A, coalesce(round(sum(l_quantity) FILTER (l_returnflag = 'N'), 2), 'NaN'::DOUBLE) AS N, coalesce(round(sum(l_quantity) FILTER (l_returnflag = 'R'), 2), 'NaN'::DOUBLE) AS R FROM lineitem GROUP BY 1")
def pivot_numeric_index(spark, d):
    t = T.pivot(table(spark, d, "lineitem"), "l_linenumber", "l_returnflag", "l_quantity")
    return t.select("l_linenumber", *(F.round(c, 2).alias(c) for c in ("A", "N", "R")))


@query("melt", "SELECT p_partkey, 'p_size' AS variable, p_size::DOUBLE AS value FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part")
def melt(spark, d):
    return T.melt(table(spark, d, "part"), ["p_partkey"], ["p_size", "p_retailprice"])


@query(
    "describe",
    " UNION ALL ".join(f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_pop({c}), 4) AS std, min({c})::DOUBLE AS min,
      quantile_cont({c}, 0.25)::DOUBLE AS "25%", quantile_cont({c}, 0.5)::DOUBLE AS "50%", quantile_cont({c}, 0.75)::DOUBLE AS "75%", max({c})::DOUBLE AS max FROM orders""" for c in ("o_orderkey", "o_custkey", "o_totalprice")),
)
def describe(spark, d):
    return T.describe(table(spark, d, "orders")).withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4)})


_RUN = "OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)"


@query("cumulative_by_group", f"SELECT o_orderkey, round(sum(o_totalprice) {_RUN}, 4) AS s, max(o_totalprice) {_RUN} AS hi, min(o_totalprice) {_RUN} AS lo, round(product(1 + o_orderkey % 3) {_RUN}, 4) AS p FROM orders")
def cumulative_by_group(spark, d):
    t = table(spark, d, "orders").withColumn("f", (1 + F.col("o_orderkey") % 3).cast("double"))
    for f, c, out in ((T.cumsum, "o_totalprice", "s"), (T.cummax, "o_totalprice", "hi"), (T.cummin, "o_totalprice", "lo"), (T.cumprod, "f", "p")):
        t = f(t, c, "o_orderkey", ["o_custkey"], out)
    return t.select("o_orderkey", F.round("s", 4).alias("s"), "hi", "lo", F.round("p", 4).alias("p"))


@query("cumsum_whole", "SELECT o_orderkey, round(sum(o_totalprice) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS s FROM orders")
def cumsum_whole(spark, d):
    return T.cumsum(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", out="s").select("o_orderkey", F.round("s", 2).alias("s"))


@query("cummax_cummin_whole", "SELECT o_orderkey, max(o_totalprice) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS hi, min(o_totalprice) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS lo FROM orders")
def cummax_cummin_whole(spark, d):
    t = T.cummax(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", out="hi")
    return T.cummin(t, "o_totalprice", "o_orderkey", out="lo").select("o_orderkey", "hi", "lo")


@query(
    "diff_pct_shift",
    """SELECT event_id, CASE WHEN p IS NULL THEN 0 ELSE round(value - p, 6) END AS df, CASE WHEN p IS NULL OR p = 0 THEN 'NaN'::DOUBLE ELSE round((value - p) / p, 6) END AS pc, p AS sh
       FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events)""",
)
def diff_pct_shift(spark, d):
    t = table(spark, d, "events").select("event_id", "user_id", "value")
    t = T.diff(t, "value", "event_id", partition_by=["user_id"], out="df")
    t = T.pct_change(t, "value", "event_id", partition_by=["user_id"], out="pc")
    t = T.shift(t, "value", 1, "event_id", ["user_id"], "sh")
    return t.select("event_id", F.round("df", 6).alias("df"), F.round("pc", 6).alias("pc"), "sh")


@query("shift_whole", "SELECT event_id, lag(value, 3) OVER (ORDER BY event_id) AS back, lead(value, 2) OVER (ORDER BY event_id) AS ahead FROM events")
def shift_whole(spark, d):
    t = T.shift(table(spark, d, "events").select("event_id", "value"), "value", 3, "event_id", out="back")
    return T.shift(t, "value", -2, "event_id", out="ahead").select("event_id", "back", "ahead")


@query("sort_values", "SELECT event_id, v, row_number() OVER (ORDER BY v NULLS LAST, event_id) AS up, row_number() OVER (ORDER BY v DESC NULLS LAST, event_id) AS down FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v FROM events)")
def sort_values(spark, d):
    from ..operators import ordered

    t = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("v"))
    up = T.sort_values(t, "v", True, ["event_id"]).withColumn("o", F.col("v").isNull().cast("int"))
    keyed = up.withColumns({"a": F.coalesce("v", F.lit(0.0)), "b": -F.coalesce("v", F.lit(0.0))})
    ranked = ordered.with_row_index(ordered.with_row_index(keyed, ["o", "a", "event_id"], "up"), ["o", "b", "event_id"], "down")
    return ranked.select("event_id", "v", (F.col("up") + 1).alias("up"), (F.col("down") + 1).alias("down"))


@query("sample_exact", "SELECT 100::BIGINT AS n, 100::BIGINT AS u FROM (SELECT 1)")
def sample_exact(spark, d):
    return T.sample(table(spark, d, "orders"), "o_orderkey", n=100, seed=7).agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("u"))


@query("group_frames", "SELECT l_returnflag, round(max(l_quantity) - min(l_quantity), 6) AS span FROM lineitem GROUP BY 1")
def group_frames(spark, d):
    def f(pdf):
        return pdf.iloc[:1][["l_returnflag"]].assign(span=round(float(pdf.l_quantity.max() - pdf.l_quantity.min()), 6))

    return T.group_frames(table(spark, d, "lineitem").select("l_returnflag", "l_quantity"), ["l_returnflag"], f, "l_returnflag string, span double")


@query("table_info", "SELECT 'n_nationkey' AS \"column\", 'int32' AS type, 0::BIGINT AS nulls UNION ALL SELECT 'n_name', 'string', 0 UNION ALL SELECT 'n_regionkey', 'int32', 0")
def table_info(spark, d):
    return T.info(table(spark, d, "nation"))
