"""Live monitors of event logs with Structured Streaming.

The source's checkpoint remembers how far the logs have been read. Late
events are bounded by a watermark where state would otherwise grow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import events as E

#: Seconds without an event after which a run counts as stopped.
SILENCE = 5.0


def tail(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the events that are appended under a path (run_id is the folder, ord the file's time and the line)."""
    lines = spark.readStream.format("text").option("recursiveFileLookup", "true").load(path)
    named = lines.select("value", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("run_id"), F.unix_micros(F.col("_metadata.file_modification_time")).alias("ord"))
    return E.parse(named)


def latest_metrics(stream: DataFrame) -> DataFrame:
    """The latest value of each metric: state is one row a key."""
    return stream.where(F.col("type") == "metric").groupBy("run_id", "key").agg(F.max_by(F.struct("step", "timestamp", "value"), F.struct("ord", "step")).alias("m")).select("run_id", "key", "m.*")


def extremes(stream: DataFrame) -> DataFrame:
    """Lowest and highest value of each metric."""
    return stream.where(F.col("type") == "metric").groupBy("run_id", "key").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("n"))


def last_seen(stream: DataFrame) -> DataFrame:
    """(run_id, seen, ended): when a run last spoke, and whether it has finished."""
    return stream.groupBy("run_id").agg(F.max("timestamp").alias("seen"), F.max_by(F.col("type") == "finished", "ord").alias("ended"))


def live_status(seen: DataFrame, now: float) -> DataFrame:
    """(run_id, status): finished, running, or stopped if it has been silent."""
    return seen.select("run_id", F.when(F.col("ended"), "finished").when(now - F.col("seen") > SILENCE, "stopped").otherwise("running").alias("status"))


def windowed(stream: DataFrame, time: str, length: str, keys: tuple[str, ...] = (), value: str | None = None, late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts, and sums of a value, by window of event time; state older than the watermark is dropped."""
    window = F.window(time, length, slide) if slide else F.window(time, length)
    folds = [F.count("*").alias("n"), *([F.sum(value).alias("total")] if value else [])]
    stream = stream.withColumn(time, F.col(time).cast("timestamp"))
    out = stream.withWatermark(time, late).groupBy(window.alias("w"), *keys).agg(*folds)
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", *(["total"] if value else []))


def run_to_memory(stream: DataFrame, name: str, mode: str, checkpoint: str | None = None) -> DataFrame:
    """Process what there is and give the result as a table (for small results and tests)."""
    writer = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True)
    query = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
