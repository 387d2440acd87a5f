"""What the training-data operators share: scratch tables, size-checked joins,
word shingles and connected components.

Scratch tables are Parquet in the folder that the cluster names in
``spark.checkpoint.dir``; they cut lineage and outlive a lost executor.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one long below which a side may be broadcast (about 16 MB built).
BROADCAST_ROWS = 1_000_000

_own: list[str] = []
_made: list[tuple[SparkSession, str]] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for scratch tables; a local one only where none is set (tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="brindle-"))
        found = _own[0]
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_root(spark)}/brindle/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


@atexit.register
def _clear() -> None:
    for spark, path in _made:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session has gone; the folder's owner clears it
            return


@contextmanager
def _settings(spark: SparkSession, **values: str):
    before = {k: spark.conf.get(k) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


#: While a scratch table is written, Arrow batches between Spark and Python are small, for Python's memory,
#: and the shuffle files of the write go when it has ended.
_WRITING = {"spark.sql.execution.arrow.maxBytesPerBatch": "8m", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` to a scratch table and read it again: lineage ends here."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    with _settings(spark, **_WRITING):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(*tables: DataFrame) -> None:
    """Delete materialized tables whose last reader has been materialized itself."""
    for t in tables:
        _delete(t.sparkSession, t._scratch_path)
        _made.remove((t.sparkSession, t._scratch_path))


#: Bytes of a scratch table (compressed) up to which it may be broadcast.
BROADCAST_BYTES = 32 << 20


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a materialized table may be broadcast: by its bytes on disk, and by its rows."""
    spark, path = df.sparkSession, getattr(df, "_scratch_path", None)
    if path is not None:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength() > BROADCAST_BYTES:
            return False
    return df.count() <= rows


def free(df: DataFrame, name: str) -> str:
    """``name``, with underscores after it if ``df`` has such a column."""
    while name.lower() in map(str.lower, df.columns):
        name += "_"
    return name


def only(df: DataFrame, ids: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """Semi or anti join with a materialized table of keys, broadcast if it is small, else shuffled."""
    keys = ids.select(key).distinct()
    return df.join(F.broadcast(keys) if is_small(ids) else keys, key, how)


# --- words and shingles -------------------------------------------------------

_rng = np.random.default_rng(20240501)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_SLOT = _rng.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = _BYTE[_LOWER]  # upper-case A-Z hash as lower case


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of an Arrow string array; null is empty."""
    import pyarrow as pa

    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(data: np.ndarray, offsets: np.ndarray, most: int = 1 << 20):
    """Row ranges of about ``most`` bytes, so that arrays made from them stay small."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def words(data: np.ndarray, offsets: np.ndarray):
    """(hash of each word, start byte of each word, end byte, first word of each row [n+1]).

    Words are runs of anything but ASCII white space, A-Z in lower case.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = _SPACE[data]
    begins = ~space
    begins[1:] &= space[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[heads] = ~space[heads]
    start = np.flatnonzero(begins)
    if not len(start):
        return np.zeros(0, np.uint64), start, start, np.zeros(len(offsets), np.int64)
    ends = ~space
    ends[:-1] &= space[1:] | begins[1:]
    end = np.flatnonzero(ends) + 1
    length = end - start
    power = np.multiply.accumulate(np.full(int(length.max()) + 1, _BASE, np.uint64))
    which = np.cumsum(begins) - 1
    place = np.arange(n) - start[np.maximum(which, 0)]
    value = np.where(space, np.uint64(0), _BYTE[data] * power[np.minimum(place, len(power) - 1)])
    value[: start[0]] = 0
    hashed = mix(np.add.reduceat(value, start) + length.astype(np.uint64))
    return hashed, start, end, np.searchsorted(start, offsets)


def shingles(hashed: np.ndarray, first: np.ndarray, n: int = 5, short: bool = True):
    """(hash of each shingle, its first word, first shingle of each row [rows+1]) of ``n`` words.

    A row of fewer words has its whole sequence as its one shingle (none if not ``short``).
    """
    total, rows = len(hashed), len(first) - 1
    padded = np.concatenate([hashed, np.zeros(n, np.uint64)])
    count = np.diff(first)
    have = np.maximum(count - n + 1, 0)
    if short:
        have = np.where((count > 0) & (count < n), 1, have)
    starts = np.concatenate([[0], np.cumsum(have)])
    row = np.repeat(np.arange(rows), have)
    at = np.arange(starts[-1]) - starts[row] + first[row]
    out = np.full(len(at), np.uint64(n), np.uint64)
    few = count[row] < n
    for k in range(n):
        term = padded[at + k] * _SLOT[k]
        if few.any():
            term = np.where(at + k < first[row + 1], term, np.uint64(k + 1))
        out += term
    assert total >= 0
    return mix(out), at, starts


# --- connected components -----------------------------------------------------


def _with_least(edges: DataFrame, low: DataFrame, hub: int | None) -> DataFrame:
    """(u, v, m): ``edges`` (u, v) with ``low`` (u, m, n) of their ``u``; nodes of over ``hub`` edges by broadcast, if there can be any."""
    if hub is None:
        return edges.join(low.drop("n"), "u")
    hubs = F.broadcast(low.where(F.col("n") > hub).select(F.col("u").alias("h"), F.col("m").alias("hm")))
    marked = edges.join(hubs, F.col("u") == F.col("h"), "left")
    cold = marked.where("h is null").select("u", "v").join(low.where(F.col("n") <= hub).select("u", "m"), "u")
    return marked.where("h is not null").select("u", "v", F.col("hm").alias("m")).unionByName(cold)


def components(edges: DataFrame, a: str, b: str, most: int = 60, hub_edges: int = 1_000_000) -> DataFrame:
    """(node, component): the smallest node reachable, for each node of an edge table.

    Alternating large-star and small-star contraction; each step is two
    grouped minima with map-side combine and joins on the node. Hubs are told
    by their degree: at most 2,000 nodes have over ``hub_edges`` and a
    thousandth of all edges each, so these meet their edges by broadcast and no
    task gathers more. Self-edges are ignored.
    """
    e = materialize(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(), "edges")
    seen = None
    for _ in range(most):
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if seen == tuple(now):
            break
        seen = tuple(now)
        hub = max(hub_edges, now[0] // 1000)  # at most 2 * edges / hub nodes have more
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = _with_least(both, low, hub if now[0] > hub else None).where("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        joined = _with_least(large, low, hub if now[0] > hub else None)
        small = joined.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        before, e = e, materialize(small.where("u > v").distinct(), "edges")
        release(before)
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
