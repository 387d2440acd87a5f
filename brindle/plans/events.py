"""Queries of event logs and of streams."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from ..operators import events as E
from ..streaming import monitor
from .registry import query, table


def _log(spark, d):
    """The events table as the log of a run for each of eight groups of users: JSON lines, read back."""
    e = table(spark, d, "events").select((F.col("user_id") % 8).cast("string").alias("run_id"), F.col("event_id").alias("ord"), "event_type", "value")
    line = F.to_json(F.struct(F.lit("metric").alias("type"), F.col("ord").alias("step"), F.col("ord").cast("double").alias("timestamp"), F.col("event_type").alias("key"), "value"))
    return E.parse(e.select("run_id", "ord", line.alias("value")))


_M = "(SELECT (user_id % 8)::VARCHAR AS run_id, event_id AS ord, event_type AS key, value FROM events)"


@query("json_props", "SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("event_latest", f"SELECT run_id, key, max(ord) AS step, arg_max(value, ord) AS value FROM {_M} GROUP BY ALL")
def event_latest(spark, d):
    return E.latest(_log(spark, d)).select("run_id", "key", "step", "value")


@query("event_history", f"SELECT run_id, ord, value FROM {_M} WHERE key = 'purchase'")
def event_history(spark, d):
    return E.history(_log(spark, d), "purchase").select("run_id", "ord", "value")


@query("event_keys", f"SELECT DISTINCT run_id, key FROM {_M}")
def event_keys(spark, d):
    return E.metric_keys(_log(spark, d))


@query("event_best", f"SELECT run_id, key, CASE WHEN key = 'error' THEN min(value) ELSE max(value) END AS best, max(ord)::DOUBLE AS timestamp FROM {_M} GROUP BY run_id, key")
def event_best(spark, d):
    return E.best(_log(spark, d))


@query("event_summary", f"SELECT run_id, key, round(CASE key WHEN 'view' THEN min(value) WHEN 'click' THEN max(value) WHEN 'purchase' THEN avg(value) ELSE arg_max(value, ord) END, 6) AS value FROM {_M} WHERE key <> 'error' GROUP BY run_id, key")
def event_summary(spark, d):
    log = _log(spark, d)
    how = spark.createDataFrame([("view", "min"), ("click", "max"), ("purchase", "mean"), ("signup", "last")], "key string, summary string")
    defined = log.select("run_id").distinct().crossJoin(F.broadcast(how)).select("run_id", F.lit(-1).cast("long").alias("ord"), F.to_json(F.struct(F.lit("define_metric").alias("type"), "key", "summary")).alias("value"))
    return E.summary(log.unionByName(E.parse(defined))).select("run_id", "key", F.round("value", 6).alias("value"))


@query("run_filter", "SELECT c_name AS run_id, c_mktsegment AS experiment FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey % 2 = 0")
def run_filter(spark, d):
    runs = table(spark, d, "customer").select(F.col("c_name").alias("run_id"), F.col("c_mktsegment").alias("experiment"), F.when(F.col("c_nationkey") % 2 == 0, "finished").otherwise("running").alias("status"))
    return E.list_runs(runs, experiment="BUILDING", status="finished").select("run_id", "experiment")


@query("run_delete", f"SELECT run_id, count(*) AS n FROM {_M} WHERE run_id NOT IN ('1', '3') GROUP BY 1")
def run_delete(spark, d):
    gone = spark.createDataFrame([("1",), ("3",)], "run_id string")
    return E.delete_runs(_log(spark, d), gone).groupBy("run_id").agg(F.count("*").alias("n"))


@query("stream_windows", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_windows(spark, d):
    """The events table read as a stream, in windows of a day; all data at once, then the state's table."""
    source = table(spark, d, "events")
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").parquet(d) if "://" not in d else None
    windows = monitor.windowed(stream if stream is not None else source, "ts", "1 day", ("event_type",), "value", late="1 day")
    if stream is not None:
        name = "brindle_" + next(tempfile._get_candidate_names()).replace("-", "_")
        windows = monitor.run_to_memory(windows, name, "complete")
    return windows.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
