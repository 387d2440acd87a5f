"""Embedding near-duplicates by int8 tile products with rigorous error bounds.

Unit vectors u are quantised to u' = s q with int8 q; e = |u - u'|. Then
|u.v - u'.v'| <= e_u (1 + e_v) + e_v (1 + e_u) + e_u e_v, since |u'| <= 1 + e.
A tile product of two blocks gives u'.v' for all their pairs (exact sums: int8
products of up to 1040 terms fit a float's mantissa, longer ones go by double).
Only pairs that the bound can't exclude are computed in double precision.

Equal vectors of a label are one vector with a count. Blocks of at most
``BLOCK_BYTES`` meet pairwise within a label (and dimension), so a hot label is
many tiles, and a tile returns link counts and a spanning forest, never its
pairs.

Rows: vectors that are null, empty, zero or hold null or non-finite components
and rows with a null label or id link with nothing (0 links, themselves as
component; component null for a null id). Vectors of different dimensions
don't link. Repeated rows of one id and vector count once. Only the named
columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, is_small, materialize

BLOCK_BYTES = 4 << 20
STRIPE = 1024


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes, scale, bound on the length of the error) of unit vectors, row by row."""
    scale = np.abs(unit).max(1) / 127
    codes = np.rint(unit / scale[:, None])
    error = np.sqrt(((unit - codes * scale[:, None]) ** 2).sum(1))
    return codes.astype(np.int8), scale, error * (1 + 1e-9) + 1e-12


class Forest:
    """Union by smaller index over whole arrays of pairs."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.parent[a], self.parent[b]
            differ = ra != rb
            if not differ.any():
                return
            a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
            np.minimum.at(self.parent, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = self.parent[self.parent]
                if (up == self.parent).all():
                    break
                self.parent = up


def tile(xa: np.ndarray, xb: np.ndarray, na: np.ndarray, nb: np.ndarray, least: float, same: bool):
    """Yield (rows of a, rows of b) of the linked pairs of two blocks, stripe by stripe; of one block (``same``) each pair once."""
    qa, sa, ea = quantise(xa / na[:, None])
    qb, sb, eb = (qa, sa, ea) if same else quantise(xb / nb[:, None])
    kind = np.float32 if xa.shape[1] <= 1040 else np.float64
    qb_t = qb.astype(kind).T
    for i in range(0, len(xa), STRIPE):
        for j in range(i if same else 0, len(xb), STRIPE):
            rows, cols = slice(i, i + STRIPE), slice(j, j + STRIPE)
            near = (qa[rows].astype(kind) @ qb_t[:, cols]).astype(np.float64) * np.outer(sa[rows], sb[cols])
            slack = ea[rows][:, None] * (1 + 2 * eb[cols]) + eb[cols] * (1 + ea[rows][:, None]) + 1e-9
            a, b = np.nonzero(near + slack >= least)
            if same and i == j:
                a, b = a[a < b], b[a < b]
            if not len(a):
                continue
            cosine = np.concatenate([np.einsum("ij,ij->i", xa[rows][a[k : k + 65536]], xb[cols][b[k : k + 65536]]) for k in range(0, len(a), 65536)])
            a, b = a + i, b + j
            linked = cosine / (na[a] * nb[b]) >= least
            yield a[linked], b[linked]


def prepared(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, dim, raw): the usable vectors as bytes of doubles."""

    def run(batches):
        for batch in batches:
            raw, dims = [], []
            for v in batch.column(2):
                x = v.values
                ok = x is not None and len(x) and not x.null_count
                if ok:
                    x = x.to_numpy(zero_copy_only=False).astype(np.float64)
                    ok = np.isfinite(x).all() and x.any()
                raw.append((x + 0.0).tobytes() if ok else None)  # -0.0 and 0.0 are one value
                dims.append(len(x) if ok else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(dims, pa.int32()), pa.array(raw, pa.binary())], ["id", "label", "dim", "raw"])

    rows = vectors.select(F.col(id_col).cast("long"), F.col(label_col).cast("string"), F.col(vector_col).cast("array<double>")).toDF("id", "label", "vector")
    rows = rows.where("id is not null and label is not null and vector is not null")
    return rows.mapInArrow(run, "id long, label string, dim int, raw binary").where("dim > 0")


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.93) -> DataFrame:
    """One row per row of ``vectors``: id, n_links, component_id (smallest id reachable), kept."""
    usable = materialize(prepared(vectors, id_col, vector_col, label_col), "vectors")
    keyed = usable.withColumn("h", F.sha1("raw"))
    copies = keyed.groupBy("label", "dim", "h").agg(F.min("id").alias("rep"), F.count_distinct("id").alias("n"))
    reps = keyed.join(copies, ["label", "dim", "h"])
    same = materialize(reps.select("id", "rep", "n").distinct(), "copies")
    size = F.least(F.lit(8192), F.greatest(F.lit(64), F.lit(BLOCK_BYTES) / 8 / F.col("dim")))
    groups = copies.groupBy("label", "dim").agg(F.count("*").alias("vectors")).withColumn("blocks", F.ceil(F.col("vectors") / size).cast("int"))
    groups = materialize(groups.select("label", "dim", "blocks"), "groups")
    side = F.broadcast(groups) if is_small(groups, 200_000) else groups
    dealt = reps.where("id = rep").dropDuplicates(["id", "label", "dim", "h"]).join(side, ["label", "dim"])
    dealt = dealt.select("label", "dim", "blocks", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), "id", "n", "raw")

    def gather(table: pa.Table) -> pa.Table:
        first = lambda c: table.column(c).slice(0, 1)
        packed = [table.column(c).combine_chunks() for c in ("id", "n", "raw")]
        ids, n = (pa.array([c.to_numpy(zero_copy_only=False).astype(np.int64).tobytes()], pa.binary()) for c in packed[:2])
        return pa.table([first("label"), first("dim"), first("blocks"), first("block"), ids, n, pa.array([b"".join(packed[2].to_pylist())], pa.binary())], ["label", "dim", "blocks", "block", "ids", "n", "raw"])

    shape = "label string, dim int, blocks int, block int, ids binary, n binary, raw binary"
    blocks = materialize(dealt.groupBy("label", "dim", "blocks", "block").applyInArrow(gather, shape), "blocks")
    left = blocks.select("label", "dim", F.explode(F.sequence("block", F.col("blocks") - 1)).alias("block"), F.col("block").alias("from"), F.col("ids").alias("ids_a"), F.col("n").alias("n_a"), F.col("raw").alias("raw_a"))
    pairs = left.join(blocks.select("label", "dim", "block", "ids", "n", "raw"), ["label", "dim", "block"])

    def compare(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda c, r=r, batch=batch: batch.column(c)[r].as_py()
                dim, one = get("dim"), get("from") == get("block")
                xa, xb = (np.frombuffer(get(c), np.float64).reshape(-1, dim) for c in ("raw_a", "raw"))
                ia, ib, ma, mb = (np.frombuffer(get(c), np.int64) for c in ("ids_a", "ids", "n_a", "n"))
                ids = ia if one else np.concatenate([ia, ib])
                shift = 0 if one else len(ia)
                links, forest = np.zeros(len(ids), np.int64), Forest(len(ids))
                for a, b in tile(xa, xb, np.sqrt((xa * xa).sum(1)), np.sqrt((xb * xb).sum(1)), least, one):
                    other = ia[a] != ib[b]  # vectors of one id are no links of each other
                    a, b = a[other], b[other]
                    links += np.bincount(a, mb[b], len(ids)).astype(np.int64)
                    links += np.bincount(b + shift, ma[a], len(ids)).astype(np.int64)
                    forest.join(a, b + shift)
                some = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some]), pa.array(ids[forest.parent[some]])], ["id", "links", "root"])

    met = materialize(pairs.select("dim", "block", "from", "ids_a", "n_a", "raw_a", "ids", "n", "raw").mapInArrow(compare, "id long, links long, root long"), "links")
    edges = met.where("id != root").select("id", "root").union(same.where("id != rep").select("id", "rep")).toDF("a", "b").distinct()
    comp = components(edges, "a", "b")
    # A copy has the links of its representative and those to the other copies.
    totals = met.groupBy("id").agg(F.sum("links").alias("links")).withColumnRenamed("id", "rep")
    counts = same.join(totals, "rep", "left").groupBy("id").agg(F.sum(F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    out = vectors.select(F.col(id_col).cast("long").alias("id")).join(counts, "id", "left").join(comp.withColumnRenamed("node", "id"), "id", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
