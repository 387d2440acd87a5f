"""Queries of the relational operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relational as R
from .registry import query, table


@query("semi_join", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def semi_join(spark, d):
    return R.semi_join(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select("o_custkey"), [("c_custkey", "o_custkey")])


@query("anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_join(spark, d):
    return R.anti_join(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select("o_custkey"), [("c_custkey", "o_custkey")])


@query("multi_key_join", "SELECT count(*) AS n, sum(a.l_orderkey)::BIGINT AS s FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey = b.l_partkey")
def multi_key_join(spark, d):
    t = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    other = t.toDF("k", "p")
    return R.multi_key_join(t, other, [("l_orderkey", "k"), ("l_partkey", "p")]).agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("s"))


@query("range_join", "SELECT event_id, low FROM events JOIN (SELECT unnest(range(0, 400, 25)) AS low) ON value >= low AND value < low + 40")
def range_join(spark, d):
    bands = spark.range(0, 400, 25).select(F.col("id").alias("low"), (F.col("id") + 40).alias("high"))
    return R.range_join(table(spark, d, "events").select("event_id", "value"), bands, "value", "low", "high", 20.0).select("event_id", "low")


@query("as_of_join", "SELECT a.event_id, b.value AS value FROM events a ASOF LEFT JOIN (SELECT user_id, event_id, value FROM events WHERE event_type = 'purchase') b ON a.user_id = b.user_id AND a.event_id >= b.event_id")
def as_of_join(spark, d):
    t = table(spark, d, "events")
    return R.as_of_join(t.select("event_id", "user_id"), t.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("seen"), "value"), ["user_id"], "event_id", "seen", ["value"]).select("event_id", "value")


_RANKED = "OVER (PARTITION BY o_orderstatus ORDER BY o_custkey)"


@query(
    "ranks",
    f"""SELECT o_orderkey, rank() {_RANKED} AS rank, dense_rank() {_RANKED} AS dense_rank, round(percent_rank() {_RANKED}, 9) AS percent_rank, round(cume_dist() {_RANKED}, 9) AS cume_dist,
       row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_custkey, o_orderkey) AS row_number, ntile(4) OVER (PARTITION BY o_orderstatus ORDER BY o_custkey, o_orderkey) AS ntile FROM orders""",
)
def ranks(spark, d):
    t = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    tied = R.ranks(t, ["o_orderstatus"], [F.col("o_custkey")]).select("o_orderkey", "rank", "dense_rank", F.round("percent_rank", 9).alias("percent_rank"), F.round("cume_dist", 9).alias("cume_dist"))
    untied = R.ranks(t, ["o_orderstatus"], [F.col("o_custkey"), F.col("o_orderkey")]).select("o_orderkey", "row_number", "ntile")
    return tied.join(untied, "o_orderkey")


@query("rollup", "SELECT l_returnflag, l_linestatus, grouping(l_returnflag, l_linestatus)::BIGINT AS level, count(*) AS n, sum(l_quantity)::BIGINT AS q FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup(spark, d):
    return R.rollup(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], n=F.count("*"), q=F.sum("l_quantity").cast("long"))


@query("cube", "SELECT l_returnflag, l_linestatus, grouping(l_returnflag, l_linestatus)::BIGINT AS level, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube(spark, d):
    return R.cube(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], n=F.count("*"))


_FILLED, _OPEN = "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'", "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'O'"


def _keys(spark, d):
    t = table(spark, d, "orders")
    return t.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")), t.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("k"))


@query("intersect_distinct", f"{_FILLED} INTERSECT {_OPEN}")
def intersect_distinct(spark, d):
    return R.intersect(*_keys(spark, d))


@query("intersect_all", f"SELECT k, count(*) AS n FROM ({_FILLED} INTERSECT ALL {_OPEN}) GROUP BY k")
def intersect_all(spark, d):
    return R.intersect(*_keys(spark, d), every=True).groupBy("k").agg(F.count("*").alias("n"))


@query("except_distinct", f"{_OPEN} EXCEPT {_FILLED}")
def except_distinct(spark, d):
    return R.except_(*_keys(spark, d)[::-1])


@query("except_all", f"SELECT k, count(*) AS n FROM ({_OPEN} EXCEPT ALL {_FILLED}) GROUP BY k")
def except_all(spark, d):
    return R.except_(*_keys(spark, d)[::-1], every=True).groupBy("k").agg(F.count("*").alias("n"))
