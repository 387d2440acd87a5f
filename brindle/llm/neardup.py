"""MinHash near-duplicates by an inverted join on signature coordinates.

Each distinct shingle set posts itself under its rarest
``coordinates - matches + 1`` (coordinate, value) pairs: two signatures that
agree in ``matches`` coordinates meet in at least one of these (prefix
filter under one global order, rare pairs first). The postings left out are
the long lists; they are skipped, and their collisions are counted by looking
the two signatures up (skip merging). Pairs with ``matches`` collisions are
confirmed on the full shingle sets.

A list of at most ``small`` sets compares all its pairs. In a longer list
every set meets the list's leader, the set whose values are the most frequent;
so most of a group of n near copies costs about n comparisons. Lists that are
one component then are done. The sets of each of the others are compared by
blocks (tiles): signatures, then full sets by matrix products, between
different components only. A tile returns a spanning forest, never its pairs. So no link
between components is lost.

The miss rate of the signature test at similarity exactly 0.75 is below 1e-6
with the defaults (32 coordinates, 12 matches); it falls above.

Rows: null or blank text has no shingles and is linked with nothing. A null
id is linked with nothing and keeps itself (component null). Repeated rows of
one id are one node; ``keep_one`` keeps one row of each text of an id. Only the
id and text columns are read, so other columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, components, free, is_small, materialize, mix, only, release, shingles, text_buffers, words

BUCKETS = 1 << 18
SIGNATURE = "id long, n_shingles long, set_a long, set_b long, sig array<int>"


def _coordinates(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    return rng.integers(1, 2**63, k, dtype=np.uint64), rng.integers(1, 2**63, k, dtype=np.uint64) | np.uint64(1)


def distinct_shingles(h: np.ndarray, starts: np.ndarray):
    """(sorted distinct hashes row by row, starts of the rows)."""
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    order = np.lexsort((h, row))
    h = h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.concatenate([[0], np.cumsum(np.bincount(row[new], minlength=len(starts) - 1))])


def signatures(docs: DataFrame, id_col: str, text_col: str, k: int = 32, n: int = 5) -> DataFrame:
    """Size, 128-bit fingerprint and MinHash signature of each row's shingle set (sig null if empty)."""

    def run(batches):
        salt, factor = _coordinates(k)
        for batch in batches:
            ids = batch.column(0)
            data, offsets = text_buffers(batch.column(1))
            for i, j, d, o in chunks(data, offsets):
                hashed, _, _, first = words(d, o)
                h, starts = distinct_shingles(*(lambda s: (s[0], s[2]))(shingles(hashed, first, n)))
                count = np.diff(starts)
                full = np.flatnonzero(count)
                at = starts[:-1][full]
                sig = np.empty((len(full), k), np.int32)
                a, b = np.zeros(j - i, np.uint64), np.zeros(j - i, np.uint64)
                if len(full):
                    for c in range(k):
                        v = (((h ^ salt[c]) * factor[c]) >> np.uint64(32)).astype(np.uint32)
                        sig[:, c] = np.minimum.reduceat(v, at).view(np.int32)
                    a[full] = np.add.reduceat(mix(h), at)
                    b[full] = np.add.reduceat(mix(h ^ np.uint64(0xA5A5A5A5DEADBEEF)), at)
                lengths = np.zeros(j - i, np.int64)
                lengths[full] = k
                arrays = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(sig.ravel()), mask=pa.array(lengths == 0))
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i).cast(pa.int64()), pa.array(count, pa.int64()), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), arrays], ["id", "n_shingles", "set_a", "set_b", "sig"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, SIGNATURE)


def _pairs_of(reps: DataFrame, k: int) -> DataFrame:
    """(id, key) for each coordinate: a 64-bit key for each coordinate-value pair."""
    return reps.select("id", F.posexplode("sig").alias("c", "v")).select("id", F.xxhash64("c", "v").alias("key"))


def postings(reps: DataFrame, k: int, matches: int) -> DataFrame:
    """(key, id, weight): each signature's rarest ``k - matches + 1`` coordinate-value pairs.

    Rarity comes from a table of ``BUCKETS`` counts over all pairs. Its size is
    fixed; collisions in it change the order, never the result. ``weight`` sums
    the rarities of all of a signature's pairs: in a group of near copies that
    of their common original is the highest.
    """
    spark = reps.sparkSession
    counts = _pairs_of(reps, k).groupBy((F.col("key").bitwiseAND(BUCKETS - 1)).cast("int").alias("bucket")).count()
    total = reps.count() * k
    heavy = counts.where(F.col("count") > max(16, 4 * total // BUCKETS)).collect()  # at most BUCKETS / 4 rows
    table = np.zeros(BUCKETS, np.int64)
    for r in heavy:
        table[r["bucket"]] = r["count"]
    shared = spark.sparkContext.broadcast(table)
    keep = k - matches + 1

    def run(batches):
        table = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("keys").flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            rank = table[keys & (BUCKETS - 1)]
            order = np.lexsort((keys, rank), axis=1)[:, :keep]
            best = np.take_along_axis(keys, order, 1)
            ids = np.repeat(batch.column("id").to_numpy(zero_copy_only=False), keep)
            weight = np.repeat((np.log2(1.0 + rank).sum(1) * 8).astype(np.int32), keep)
            yield pa.RecordBatch.from_arrays([pa.array(best.ravel()), pa.array(ids), pa.array(weight)], ["key", "id", "weight"])

    keyed = reps.select("id", F.transform("sig", lambda v, c: F.xxhash64(c, v)).alias("keys"))
    return keyed.mapInArrow(run, "key long, id long, weight int")


def _confirmed(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, n: int, percent: int) -> DataFrame:
    """Those of the materialized (a, b) pairs whose full shingle sets are similar enough."""

    def compare(batches):
        for batch in batches:
            a, b = batch.column("set_a"), batch.column("set_b")
            keep = np.zeros(batch.num_rows, bool)
            for r in range(batch.num_rows):
                x, y = np.frombuffer(a[r].as_buffer(), np.uint64), np.frombuffer(b[r].as_buffer(), np.uint64)
                if min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep[r] = 100 * both >= percent * (len(x) + len(y) - both)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    need = materialize(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "need")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    full = materialize(_shingle_sets(only(rows, need, "id"), n), "sets")
    joined = pairs.join(full.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b").join(full.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a")
    return joined.select("a", "b", "set_a", "set_b").mapInArrow(compare, "a long, b long")


def _colliding(pairs: DataFrame, reps: DataFrame, matches: int) -> DataFrame:
    """The pairs whose signatures agree in ``matches`` coordinates at least."""
    sig = reps.select("id", "sig")
    both = pairs.join(sig.select(F.col("id").alias("a"), F.col("sig").alias("x")), "a").join(sig.select(F.col("id").alias("b"), F.col("sig").alias("y")), "b")
    return both.where(F.size(F.filter(F.zip_with("x", "y", lambda x, y: x == y), lambda e: e)) >= matches).select("a", "b")


def links(reps: DataFrame, docs: DataFrame, id_col: str, text_col: str, k: int, matches: int, n: int, percent: int, small: int) -> DataFrame | None:
    """Confirmed (a, b) links that connect all that is linked, between distinct shingle sets."""
    posted = materialize(postings(reps, k, matches), "postings")
    lists = posted.groupBy("key").agg(F.count("*").alias("n"), F.max(F.struct("weight", F.xxhash64("id").alias("p"), "id")).alias("lead")).where("n > 1")
    post = materialize(posted.join(lists.select("key", "n", F.col("lead.id").alias("lead")), "key"), "lists")
    release(posted)
    short = post.where(F.col("n") <= small).groupBy("key").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    crossed = short.select(F.posexplode("ids").alias("i", "a"), "ids").select("a", F.explode(F.slice("ids", F.col("i") + 2, F.size("ids"))).alias("b"))
    starred = post.where(F.col("n") > small).where("id != lead").select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b"))
    tried = materialize(crossed.union(starred).groupBy("a", "b").agg(F.count("*").alias("met")), "tried")
    # Enough collisions in the posted lists decide; fewer may be made up for in the skipped ones.
    decided = tried.where(F.col("met") >= matches).select("a", "b")
    open_ = tried.where(F.col("met") < matches).select("a", "b")
    found = materialize(_confirmed(materialize(decided.union(_colliding(open_, reps, matches)), "pairs"), docs, id_col, text_col, n, percent).distinct(), "links")
    long = post.where(F.col("n") > small).select("key", "id")
    comp = components(found, "a", "b")
    marked = long.join(comp.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("comp"))
    split = marked.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
    marked = materialize(marked.join(split.select("key"), "key"), "split")
    if marked.isEmpty():
        return found
    rest = materialize(marked.withColumnRenamed("key", "grp").join(reps.select("id", "sig"), "id"), "rest")
    return found.union(materialize(_tiled(rest, docs, id_col, text_col, matches, n, percent), "links"))


#: Of a block of documents: how many, and how many bytes of shingles.
BLOCK_ROWS, BLOCK_BYTES = 2048, 8 << 20


def _shingle_sets(rows: DataFrame, n: int) -> DataFrame:
    """(id, set): the sorted distinct shingle hashes of (id, text) rows, as bytes."""

    def sets(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for i, j, d, o in chunks(data, offsets):
                hashed, _, _, first = words(d, o)
                h, _, starts = shingles(hashed, first, n)
                h, starts = distinct_shingles(h, starts)
                raw = [h[starts[r] : starts[r + 1]].tobytes() for r in range(j - i)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).cast(pa.int64()), pa.array(raw, pa.binary())], ["id", "set"])

    return rows.mapInArrow(sets, "id long, set binary")


def _intersections(a: list[np.ndarray], b: list[np.ndarray], rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """|a[i] & b[j]| for each (i, j): by pair if these are few, else by 0/1 matrix products over the shingles both sides have."""
    if len(rows) <= 2000:
        return np.array([len(np.intersect1d(a[i], b[j], assume_unique=True)) for i, j in zip(rows.tolist(), cols.tolist(), strict=True)], np.int64)
    ra, rb = np.unique(rows), np.unique(cols)
    ha, hb = np.concatenate([a[i] for i in ra]), np.concatenate([b[j] for j in rb])
    vocabulary = np.intersect1d(ha, hb)
    ia, ib = np.repeat(np.arange(len(ra)), [len(a[i]) for i in ra]), np.repeat(np.arange(len(rb)), [len(b[j]) for j in rb])
    placed = []
    for h, i in ((ha, ia), (hb, ib)):
        at = np.searchsorted(vocabulary, h)
        ok = (at < len(vocabulary)) & (vocabulary[np.minimum(at, max(len(vocabulary) - 1, 0))] == h) if len(vocabulary) else np.zeros(len(h), bool)
        placed.append((i[ok], at[ok]))
    count = np.zeros((len(ra), len(rb)), np.float32)
    for low in range(0, len(vocabulary), 4096):
        sides = []
        for (i, at), size in zip(placed, (len(ra), len(rb)), strict=True):
            here = (at >= low) & (at < low + 4096)
            x = np.zeros((size, min(4096, len(vocabulary) - low)), np.float32)
            x[i[here], at[here] - low] = 1
            sides.append(x)
        count += sides[0] @ sides[1].T
    return count[np.searchsorted(ra, rows), np.searchsorted(rb, cols)].astype(np.int64)


def _tiles(rows: DataFrame, size, settle) -> DataFrame:
    """(a, b): what ``settle`` returns for each pair of blocks of each group of (id, comp, grp, sig, set).

    A group is dealt into blocks, the rows of its largest component apart from
    the others: blocks of that component needn't meet each other. Each row goes
    to the tiles of its block, one small row a document; tiles are put
    together in Python, one at a time.
    """
    held = F.sum(size) if size is not None else F.lit(0)
    by = rows.groupBy("grp", "comp").agg(F.count("*").alias("n"), held.alias("bytes"))
    whole = by.groupBy("grp").agg(F.max(F.struct("n", "comp", "bytes")).alias("main"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))

    def blocks(n, held):
        return F.ceil(F.greatest(n / BLOCK_ROWS, held / BLOCK_BYTES)).cast("int")

    mains, odds = blocks(F.col("main.n"), F.col("main.bytes")), blocks(F.col("n") - F.col("main.n"), F.col("bytes") - F.col("main.bytes"))
    groups = materialize(whole.select("grp", F.col("main.comp").alias("main"), mains.alias("mains"), odds.alias("odds")).where("odds > 0"), "groups")
    dealt = rows.join(F.broadcast(groups) if is_small(groups, 200_000) else groups, "grp").withColumn("odd", F.col("comp") != F.col("main")).drop("main")
    within = F.when(F.col("odd"), F.col("mains") + F.pmod(F.xxhash64("id"), F.greatest("odds", F.lit(1)))).otherwise(F.pmod(F.xxhash64("id"), F.greatest("mains", F.lit(1))))
    dealt = dealt.withColumn("block", within.cast("int"))
    partners = F.when(F.col("odd"), F.sequence(F.lit(0), F.col("mains") + F.col("odds") - 1)).otherwise(F.sequence(F.col("mains"), F.col("mains") + F.col("odds") - 1))
    other = dealt.withColumn("with", F.explode(partners))
    rest = [c for c in ("sig", "set") if c in rows.columns]
    spread = other.select("grp", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"), "block", "id", "comp", *rest)
    keys = ("grp", "low", "high")

    def compare(batches):
        at, held = None, []

        def settled():
            block, ids, comps, sig = (np.concatenate([x[i] for x in held]) for i in range(4))
            sets = sum((x[4] for x in held), [])
            sides = [np.flatnonzero(block == k) for k in at[1:]]
            a, b = settle(*((ids[x], comps[x], sig[x], [sets[i] for i in x.tolist()] if sets else []) for x in sides), at[1] == at[2])
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            key = [batch.column(c).to_numpy(zero_copy_only=False) for c in keys]
            edge = np.flatnonzero((np.diff(key[0]) != 0) | (np.diff(key[1]) != 0) | (np.diff(key[2]) != 0)) + 1
            for x, y in zip([0, *edge.tolist()], [*edge.tolist(), n], strict=True):
                now = tuple(int(k[x]) for k in key)
                if now != at:
                    if held:
                        yield settled()
                    at, held = now, []
                part = batch.slice(x, y - x)
                sig = part.column("sig").flatten().to_numpy(zero_copy_only=False).reshape(y - x, -1)
                sets = [np.frombuffer(v.as_buffer(), np.uint64).copy() for v in part.column("set")] if "set" in rest else []
                held.append([*(part.column(c).to_numpy(zero_copy_only=False) for c in ("block", "id", "comp")), sig.copy(), sets])
        if held:
            yield settled()

    dealt_out = spread.repartition(*keys).sortWithinPartitions(*keys, "block")
    return dealt_out.mapInArrow(compare, "a long, b long").distinct()


def _tiled(rest: DataFrame, docs: DataFrame, id_col: str, text_col: str, matches: int, n: int, percent: int) -> DataFrame:
    """(a, b): links between components of one list (id, comp, grp, sig), enough to join all that are linked.

    Lists hold unlike sets, so signatures alone are compared first, list by
    list: what they connect are small groups of likes, in which the full sets
    are compared. Lists aren't chained into groups: these would tend towards
    the whole table as it grows, and with them each row's tiles.
    """
    alike = materialize(_tiles(rest, None, lambda left, right, same: _alike(left, right, matches, same)), "alike")
    if alike.isEmpty():
        return alike
    refined = components(alike, "a", "b").select(F.col("node").alias("id"), F.col("component").alias("grp"))
    likes = rest.drop("grp").join(refined, "id").dropDuplicates(["id"])
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    likes = materialize(likes, "likes")
    full = materialize(_shingle_sets(only(source, likes, "id"), n).join(likes, "id"), "likes-sets")
    return _tiles(full, F.octet_length("set"), lambda left, right, same: _tile_links(left, right, matches, percent, same))


#: Rows of a block that are compared with the other block at once: all pairs of two blocks take hundreds of MB.
STRIP_ROWS = 256


def _close(left: tuple, right: tuple, matches: int, same: bool):
    """Yield (rows of left, rows of right) of the pairs of two blocks (ids, components, signatures, sets) whose signatures collide often enough and whose components differ, strip by strip."""
    (_, ca, ga, _), (_, cb, gb, _) = left, right
    for low in range(0, len(ca), STRIP_ROWS):
        rows = slice(low, low + STRIP_ROWS)
        met = np.zeros((len(ca[rows]), len(cb)), np.int8)
        for c in range(ga.shape[1]):
            met += ga[rows, c][:, None] == gb[:, c]
        close = (met >= matches) & (ca[rows][:, None] != cb)
        x, y = np.nonzero(np.triu(close, 1 + low) if same else close)
        if len(x):
            yield x + low, y


def _alike(left: tuple, right: tuple, matches: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, over ids, of the pairs whose signatures collide often enough."""
    from .embeddings import Forest

    nodes, at = np.unique(np.concatenate([left[0], right[0]]), return_inverse=True)
    ia, ib = at[: len(left[0])], at[len(left[0]) :]
    forest = Forest(len(nodes))
    for x, y in _close(left, right, matches, same):
        forest.join(ia[x], ib[y])
    moved = np.flatnonzero(forest.parent != np.arange(len(nodes)))
    return nodes[forest.parent[moved]], nodes[moved]


def _tile_links(left: tuple, right: tuple, matches: int, percent: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of components that links of two blocks join: a spanning forest."""
    from .embeddings import Forest

    (_, ca, _, sa), (_, cb, _, sb) = left, right
    na, nb = (np.array([len(x) for x in s], np.int64) for s in (sa, sb))
    nodes, at = np.unique(np.concatenate([ca, cb]), return_inverse=True)
    ia, ib = at[: len(ca)], at[len(ca) :]
    forest = Forest(len(nodes))
    for x, y in _close(left, right, matches, same):
        apart = forest.parent[ia[x]] != forest.parent[ib[y]]  # what earlier strips have joined needs no link
        apart &= np.minimum(na[x], nb[y]) * 100 >= percent * np.maximum(na[x], nb[y])
        x, y = x[apart], y[apart]
        if len(x):
            both = _intersections(sa, sb, x, y)
            ok = 100 * both >= percent * (na[x] + nb[y] - both)
            forest.join(ia[x[ok]], ib[y[ok]])
    moved = np.flatnonzero(forest.parent != np.arange(len(nodes)))
    return nodes[forest.parent[moved]], nodes[moved]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, coordinates: int = 32, matches: int = 12, shingle: int = 5, percent: int = 75, small: int = 6) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (smallest id reachable by links), kept.

    Two rows are linked if 100 * |intersection| >= percent * |union| of their
    shingle sets. Equal sets are joined by their fingerprint first and only one
    of them is compared.
    """
    sig = materialize(signatures(docs, id_col, text_col, coordinates, shingle), "sig")
    some = sig.where("n_shingles > 0 and id is not null")
    first = some.groupBy("set_a", "set_b").agg(F.min("id").alias("rep"))
    reps = materialize(some.join(first, ["set_a", "set_b"]).where("id = rep").select("id", "sig").dropDuplicates(["id"]), "reps")
    found = links(reps, docs, id_col, text_col, coordinates, matches, shingle, percent, small)
    same = some.join(first, ["set_a", "set_b"]).where("id != rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    comp = materialize(components(found.union(same), "a", "b"), "components")
    out = sig.select("id", "n_shingles").join(comp.select(F.col("node").alias("id"), "component"), "id", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, its columns as they were."""
    name, key = free(docs, "__near_id"), free(docs, "__near_text")
    found = materialize(near_duplicates(docs, id_col, text_col, **options).select(F.col(id_col).alias(name), "kept"), "kept")
    gone = materialize(found.where(~F.col("kept")).select(name).distinct(), "gone")
    rest = only(docs.withColumn(name, F.col(id_col).cast("long")), gone, name, "left_anti")
    again = materialize(found.where("kept").where(F.col(name).isNotNull()).groupBy(name).count().where("count > 1").select(name), "again")
    if not again.isEmpty():  # rows of one id: only these are shuffled with their texts
        keyed = rest.withColumn(key, F.sha2(F.col(text_col).cast("string"), 256))
        rest = only(rest, again, name, "left_anti").unionByName(only(keyed, again, name).dropDuplicates([name, key]).drop(key))
    return rest.select(*docs.columns)
