"""Conflict-constrained best-fit packing of documents into sequences.

A text of more than ``capacity`` words is cut into pieces of ``capacity`` words
and a rest. Pieces are dealt by hash to shards of about ``shard_pieces``, whose
number grows with the input; a shard is packed in one task, longest piece
first. Its open bins are ordered by what room they have left, and each carries
a bitmap of the sources and one of the duplicate clusters in it. A piece goes to
the tightest bin that has room for it and holds neither its source nor its
cluster: the search starts at the smallest sufficient room and goes on to the
next larger until a bin is compatible, else it opens a bin.

Only (id, source, cluster, length) are shuffled, never texts, and a hot source
or cluster spreads over all shards.

Rows: every row gives one piece at least (null or blank text: one of length 0).
A null source conflicts with nothing. Null ids and repeated rows are packed
like any other row. Only the named columns are read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

_WHITE = " \t\n\x0b\x0c\r"


def n_words(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(_WHITE))
    return F.when(F.length(trimmed) > 0, F.regexp_count(trimmed, F.lit(r"[\x20\x09-\x0D]+")) + 1).otherwise(0)


def pieces(docs: DataFrame, capacity: int, id_col: str, text_col: str, source_col: str | None, cluster_col: str | None) -> DataFrame:
    """(id, source, cluster, piece, start, n_tokens): the cuts of every row, in words."""
    text = F.col(text_col).cast("string")
    source = F.col(source_col).cast("string") if source_col else F.lit(None).cast("string")
    cluster = F.col(cluster_col).cast("string").alias("c") if cluster_col else F.xxhash64(F.lower(F.btrim(F.coalesce(text, F.lit(""))))).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), source.alias("source"), cluster.alias("cluster"), n_words(text).alias("n"))
    count = F.greatest(F.lit(1), F.ceil(F.col("n") / capacity)).cast("int")
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), count - 1)).alias("piece"))
    start = F.col("piece") * capacity
    return rows.select("id", "source", "cluster", "piece", start.alias("start"), F.least(F.col("n") - start, F.lit(capacity)).alias("n_tokens"))


def best_fit(lengths: list[int], sources: list, clusters: list, capacity: int) -> list[int]:
    """The bin of each piece; pieces come longest first. Equal clusters and equal sources never share a bin."""
    twice = {c for c, n in Counter(clusters).items() if n > 1 and c is not None}
    source_bit = {s: 1 << i for i, s in enumerate(dict.fromkeys(s for s in sources if s is not None))}
    cluster_bit = {c: 1 << i for i, c in enumerate(sorted(twice))}
    open_bins: list[tuple[int, int]] = []  # (room, bin), by room
    held_sources: list[int] = []
    held_clusters: list[int] = []
    out = []
    for n, s, c in zip(lengths, sources, clusters, strict=True):
        sb, cb = source_bit.get(s, 0), cluster_bit.get(c, 0)
        at, end = bisect_left(open_bins, (n, -1)), len(open_bins)
        while at < end:
            b = open_bins[at][1]
            if not (held_sources[b] & sb or held_clusters[b] & cb):
                break
            at += 1
        if at < end:
            room, b = open_bins.pop(at)
        else:
            room, b = capacity, len(held_sources)
            held_sources.append(0)
            held_clusters.append(0)
        held_sources[b] |= sb
        held_clusters[b] |= cb
        if room > n or n == 0:
            insort(open_bins, (room - n, b))
        out.append(b)
    return out


def pack(docs: DataFrame, *, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", source_col: str | None = "source", cluster_col: str | None = None, clusters: DataFrame | None = None, shard_pieces: int = 4096) -> DataFrame:
    """One row per piece: id, piece, start (word), n_tokens, bin_id, position (in the bin), offset (words before it in the bin).

    ``cluster_col`` names the duplicate cluster; without it, equal texts but for
    case and outer blanks are a cluster. ``clusters`` (id, cluster; one row an
    id) names them by id instead; it is joined with lengths, not with texts.
    """
    cut = pieces(docs, capacity, id_col, text_col, source_col, cluster_col)
    if clusters is not None:
        cut = cut.join(clusters.toDF("id", "known"), "id", "left").withColumn("cluster", F.coalesce(F.col("known").cast("string"), "cluster")).drop("known")
    cut = materialize(cut, "pieces")
    shards = max(1, -(-cut.count() // shard_pieces))

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("id").fill_null(-(2**63)).to_numpy()
        n, piece = table.column("n_tokens").to_numpy(), table.column("piece").to_numpy()
        cluster = np.array([x or "" for x in table.column("cluster").to_pylist()])
        order = np.lexsort((cluster, piece, ids, -n))
        table = table.take(pa.array(order))
        lengths = table.column("n_tokens").to_pylist()
        bins = best_fit(lengths, table.column("source").to_pylist(), table.column("cluster").to_pylist(), capacity)
        placed: dict[int, tuple[int, int]] = {}
        position, offset = [], []
        for b, x in zip(bins, lengths, strict=True):
            p, o = placed.get(b, (0, 0))
            position.append(p)
            offset.append(o)
            placed[b] = (p + 1, o + x)
        shard = table.column("shard")[0].as_py()
        long = lambda x: pa.array(x, pa.int64())
        bin_ids = long([shard * 2**24 + b for b in bins])
        return pa.table([table.column("id"), table.column("piece").cast(pa.int64()), table.column("start").cast(pa.int64()), long(lengths), bin_ids, long(position), long(offset)], [id_col, "piece", "start", "n_tokens", "bin_id", "position", "offset"])

    shard = F.pmod(F.xxhash64("id", "piece", "cluster"), F.lit(shards)).alias("shard")
    dealt = cut.select("*", shard).groupBy("shard")
    return dealt.applyInArrow(run, f"{id_col} long, piece long, start long, n_tokens long, bin_id long, position long, offset long")


def assemble(docs: DataFrame, packed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(bin_id, text): the packed sequences themselves, pieces in order, joined by a blank line."""
    w = F.split(F.btrim(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(_WHITE)), r"[\x20\x09-\x0D]+")
    rows = docs.select(F.col(id_col).alias("__id"), w.alias("__w")).join(packed.withColumnRenamed(id_col, "__key"), F.col("__id") == F.col("__key"))
    part = F.array_join(F.slice("__w", F.col("start") + 1, F.col("n_tokens")), " ")
    gathered = rows.groupBy("bin_id").agg(F.array_sort(F.collect_list(F.struct("position", part.alias("t")))).alias("parts"))  # a bin holds capacity words at most
    return gathered.select("bin_id", F.array_join(F.transform("parts", lambda p: p["t"]), "\n\n").alias("text"))
