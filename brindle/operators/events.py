"""Event logs of experiment runs: append-only JSON lines, read as tables.

An event has a run, its place in that run's log (``ord``; file order counts,
not the timestamp), a type and that type's fields. Everything about a run is
an aggregate over its events.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EVENT = "type string, step bigint, timestamp double, key string, value double, summary string, step_metric string, goal string, kind string, path string, values map<string,string>, tags array<string>, name string, version string, at double, status string, ended_at double, note string"
TYPES = ("metric", "define_metric", "media", "summary", "notes", "tags", "artifact_output", "artifact_input", "resumed", "finished")


def parse(lines: DataFrame, text: str = "value", keys: Sequence[str] = ("run_id", "ord")) -> DataFrame:
    """Events of JSON lines; lines that are no event are dropped.

    ``value`` of notes and ``values`` of tags have other types than those of
    metrics and summaries, so each is read from the JSON by type.
    """
    get = lambda f: F.get_json_object(text, f"$.{f}")
    kind = get("type")
    fields = {
        "type": kind, "step": get("step").try_cast("bigint"), "timestamp": get("timestamp").try_cast("double"), "key": get("key"),
        "value": F.when(kind != "notes", get("value").try_cast("double")), "summary": get("summary"), "step_metric": get("step_metric"), "goal": get("goal"),
        "kind": get("kind"), "path": get("path"), "values": F.when(kind == "summary", F.from_json(get("values"), "map<string,string>")),
        "tags": F.when(kind == "tags", F.from_json(get("values"), "array<string>")), "name": get("name"), "version": get("version"),
        "at": get("at").try_cast("double"), "status": get("status"), "ended_at": get("ended_at").try_cast("double"), "note": F.when(kind == "notes", get("value")),
    }
    return lines.select(*keys, *(c.alias(n) for n, c in fields.items())).where(F.col("type").isin(*TYPES))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Events of log files: the run is the files' folder, ``ord`` the line's place: file by name, block, line.

    Sessions number the files that they flush, so later lines come later.
    """
    place = F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), place.alias("ord"))
    run = F.element_at(F.split("file", "/"), -2)
    return parse(lines.select("value", run.alias("run_id"), "ord"))


def to_lines(events: DataFrame) -> DataFrame:
    """(run_id, ord, value): events as JSON lines, null fields left out."""
    value = F.when(F.col("type") == "notes", F.to_json(F.struct("type", F.col("note").alias("value"))))
    tags = F.when(F.col("type") == "tags", F.to_json(F.struct("type", F.col("tags").alias("values"))))
    rest = F.to_json(F.struct(*(c for c in events.columns if c not in ("run_id", "ord", "note", "tags"))))
    return events.select("run_id", "ord", F.coalesce(value, tags, rest).alias("value"))


# --- metrics ------------------------------------------------------------------


def _metrics(events: DataFrame) -> DataFrame:
    return events.where(F.col("type") == "metric")


def live(events: DataFrame) -> DataFrame:
    """Without what was written after a finish and before the next resume."""
    w = Window.partitionBy("run_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("type").isin("finished", "resumed"), F.col("type")), ignorenulls=True).over(w)
    return events.withColumn("__last", last).where((F.coalesce("__last", F.lit("")) != "finished") | (F.col("type") == "resumed")).drop("__last")


def metric_keys(events: DataFrame) -> DataFrame:
    return _metrics(events).select("run_id", "key").distinct()


def latest(events: DataFrame, by: Sequence[str] = ("run_id", "key")) -> DataFrame:
    """The last line of each key: step, timestamp and value."""
    last = F.max_by(F.struct("step", "timestamp", "value"), "ord")
    return _metrics(events).groupBy(*by).agg(last.alias("m")).select(*by, "m.*")


def history(events: DataFrame, key: str) -> DataFrame:
    """(run_id, ord, step, timestamp, value) of a metric, in log order."""
    return _metrics(events).where(F.col("key") == key).select("run_id", "ord", "step", "timestamp", "value").orderBy("run_id", "ord")


def definitions(events: DataFrame) -> DataFrame:
    """The last definition of each metric."""
    last = F.max_by(F.struct("summary", "step_metric", "goal"), "ord")
    return events.where(F.col("type") == "define_metric").groupBy("run_id", "key").agg(last.alias("d")).select("run_id", "key", "d.*")


def minimised(key: Column) -> Column:
    """What a metric without a goal is for: loss and error are to fall."""
    return F.lower(key).contains("loss") | F.lower(key).contains("error")


def best(events: DataFrame) -> DataFrame:
    """(run_id, key, best, timestamp): by goal, else by name; the timestamp is the latest one."""
    m = _metrics(events).groupBy("run_id", "key").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.max_by("timestamp", "ord").alias("timestamp"))
    d = definitions(events).select("run_id", "key", "goal")
    falls = F.coalesce(F.lower(F.col("goal")).startswith("min"), minimised(F.col("key")))
    return m.join(d, ["run_id", "key"], "left").select("run_id", "key", F.when(falls, F.col("low")).otherwise(F.col("high")).alias("best"), "timestamp")


def summary(events: DataFrame) -> DataFrame:
    """(run_id, key, value): explicit summaries, the last one of a key; others by the metric's definition."""
    given = events.where(F.col("type") == "summary").select("run_id", "ord", F.explode("values").alias("key", "text"))
    given = given.groupBy("run_id", "key").agg(F.max_by("text", "ord").try_cast("double").alias("value"))
    stats = _metrics(events).groupBy("run_id", "key").agg(F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.max_by("value", "ord").alias("last"))
    how = F.col("summary")
    auto = stats.join(definitions(events).where(F.col("summary").isin("min", "max", "mean", "last")), ["run_id", "key"])
    auto = auto.select("run_id", "key", F.when(how == "min", F.col("min")).when(how == "max", F.col("max")).when(how == "mean", F.col("mean")).otherwise(F.col("last")).alias("value"))
    return given.union(auto.join(given, ["run_id", "key"], "left_anti"))


def status(events: DataFrame) -> DataFrame:
    """(run_id, status, ended_at): as the last finish or resume says, else running."""
    change = F.col("type").isin("finished", "resumed")
    last = F.max_by(F.struct("type", "status", "ended_at"), F.when(change, F.col("ord")))
    by = events.groupBy("run_id").agg(last.alias("s"))
    finished = F.col("s.type") == "finished"
    return by.select("run_id", F.when(finished, F.coalesce("s.status", F.lit("finished"))).otherwise("running").alias("status"), F.when(finished, F.col("s.ended_at")).alias("ended_at"))


def notes(events: DataFrame) -> DataFrame:
    return events.where(F.col("type") == "notes").groupBy("run_id").agg(F.max_by("note", "ord").alias("notes"))


def tags(events: DataFrame) -> DataFrame:
    """(run_id, tags): each once, in the order of first appearance."""
    each = events.where(F.col("type") == "tags").select("run_id", "ord", F.posexplode("tags").alias("pos", "tag"))
    first = each.groupBy("run_id", "tag").agg(F.min(F.struct("ord", "pos")).alias("o"))
    return first.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "tag"))), lambda x: x["tag"]).alias("tags"))


def media(events: DataFrame, key: str | None = None) -> DataFrame:
    found = events.where(F.col("type") == "media")
    return (found if key is None else found.where(F.col("key") == key)).select("run_id", "ord", "step", "timestamp", "key", "kind", "path")


def artifacts(events: DataFrame, direction: str = "output") -> DataFrame:
    return events.where(F.col("type") == f"artifact_{direction}").select("run_id", "ord", "name", "version")


# --- the store: one row a run --------------------------------------------------


def experiments(runs: DataFrame) -> DataFrame:
    return runs.select("experiment").distinct()


def list_runs(runs: DataFrame, experiment: str | None = None, status: str | None = None, tag: str | None = None, parent: str | None = None, group: str | None = None) -> DataFrame:
    """Runs that meet all conditions, newest (largest id) first."""
    for column, wanted in (("experiment", experiment), ("status", status), ("parent_id", parent), ("group", group)):
        runs = runs if wanted is None else runs.where(F.col(column) == wanted)
    runs = runs if tag is None else runs.where(F.array_contains("tags", tag))
    return runs.orderBy(F.desc("run_id"))


def find_run(runs: DataFrame, run_id: str) -> DataFrame:
    return runs.where(F.col("run_id") == run_id)


def latest_run(runs: DataFrame, **conditions) -> DataFrame:
    return list_runs(runs, **conditions).limit(1)


def children(runs: DataFrame) -> DataFrame:
    """(run_id, child)."""
    return runs.where(F.col("parent_id").isNotNull()).select(F.col("parent_id").alias("run_id"), F.col("run_id").alias("child"))


def delete_runs(frame: DataFrame, gone: DataFrame) -> DataFrame:
    """A table of runs or events without some runs."""
    return frame.join(gone.select("run_id").distinct(), "run_id", "left_anti")


def unreferenced(blobs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Blobs that no artifact names."""
    return blobs.join(artifacts.select("digest").distinct(), "digest", "left_anti")


def artifact_digest(content: str | Column) -> Column:
    return F.sha2(content, 256)


# --- writing ------------------------------------------------------------------


class Session:
    """A run being written: events are appended as JSON lines when it is flushed."""

    def __init__(self, spark: SparkSession, root: str, experiment: str, run_id: str, resume: bool = False) -> None:
        self.spark, self.run_id, self.path = spark, run_id, f"{root.rstrip('/')}/{experiment}/{run_id}"
        self._lines: list[dict] = []
        if resume:
            self._add("resumed")

    def _add(self, kind: str, **fields) -> None:
        self._lines.append({"type": kind} | {k: v for k, v in fields.items() if v is not None})

    def log_metric(self, key: str, value: float, step: int, timestamp: float | None = None) -> None:
        self._add("metric", key=key, value=float(value), step=step, timestamp=timestamp)

    def log_metrics(self, values: dict[str, float], step: int, timestamp: float | None = None) -> None:
        for k, v in values.items():
            self.log_metric(k, v, step, timestamp)

    def define_metric(self, key: str, summary: str = "last", step_metric: str | None = None, goal: str | None = None) -> None:
        self._add("define_metric", key=key, summary=summary, step_metric=step_metric, goal=goal)

    def log_media(self, key: str, path: str, kind: str, step: int, timestamp: float | None = None) -> None:
        self._add("media", key=key, path=path, kind=kind, step=step, timestamp=timestamp)

    def log_table(self, key: str, table: DataFrame, step: int) -> None:
        path = f"{self.path}/tables/{key}-{step}"
        table.write.parquet(path)
        self.log_media(key, path, "table", step)

    def set_notes(self, text: str) -> None:
        self._add("notes", value=text)

    def set_summary(self, **values) -> None:
        self._add("summary", values={k: str(v) for k, v in values.items()})

    def add_tags(self, *tags: str) -> None:
        self._add("tags", values=list(tags))

    def log_artifact(self, name: str, version: str) -> None:
        self._add("artifact_output", name=name, version=version)

    def use_artifact(self, name: str, version: str) -> None:
        self._add("artifact_input", name=name, version=version)

    def finish(self, status: str = "finished", ended_at: float | None = None) -> None:
        self._add("finished", status=status, ended_at=ended_at)
        self.flush()

    def flush(self) -> None:
        """Append the events as one more file, numbered after those that are there."""
        import json

        if self._lines:
            jvm = self.spark.sparkContext._jvm
            folder = jvm.org.apache.hadoop.fs.Path(self.path)
            fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
            there = [x.getPath().getName() for x in fs.listStatus(folder)] if fs.exists(folder) else []
            number = 1 + max((int(x[7:-6]) for x in there if x.startswith("events-") and x.endswith(".jsonl")), default=0)
            out = fs.create(jvm.org.apache.hadoop.fs.Path(f"{self.path}/events-{number:08}.jsonl"), False)
            try:
                out.write(bytearray("".join(json.dumps(x) + "\n" for x in self._lines).encode()))
            finally:
                out.close()
            self._lines = []

    def __enter__(self) -> Session:
        return self

    def __exit__(self, kind, *_) -> None:
        self.finish("finished" if kind is None else "failed")


# --- values -------------------------------------------------------------------


def value_to_float(v) -> Column:
    return F.col(v).try_cast("double") if isinstance(v, str) else v.try_cast("double")


def value_to_int(v) -> Column:
    return F.col(v).try_cast("bigint") if isinstance(v, str) else v.try_cast("bigint")


def value_to_bool(v) -> Column:
    return F.col(v).try_cast("boolean") if isinstance(v, str) else v.try_cast("boolean")
