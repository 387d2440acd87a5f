"""Benchmark decontamination by size-partitioned MinHash containment, in DataFrame operations only.

An item's sketch is the ``k`` shingles with the lowest hash (bottom-k MinHash).
Items are partitioned by size (powers of two), and each partition takes
``k = (100 - percent)% of its upper size + 1``. A document that holds
``percent`` of an item's shingles then holds at least one of any ``k`` of
them, so a search for sketch shingles in a document's shingles, however long
it is, misses nothing. Candidates are verified by exact shingle containment.

Words are runs of non-white characters, lower-cased; shingles are five words
(an item of fewer words is one shingle of all its words).

Rows: null or blank text holds nothing and an item without words matches
nothing. Repeated rows of an id count once, with the highest containment.
A null document id is reported as such. ``drop_contaminated`` decides by id and
text, so a clean row stays whatever shares its id, and a row without an id goes
if it holds an item. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, free, is_small, materialize

_WHITE = " \t\n\x0b\x0c\r"


def word_list(text: Column) -> Column:
    """The words of a text; none for null or blank."""
    trimmed = F.btrim(F.lower(text), F.lit(_WHITE))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))


def shingle_hashes(w: Column, n: int) -> Column:
    """The distinct hashes of the runs of ``n`` words in an array of words."""
    last = F.size(w) - n
    at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.xxhash64(F.lit(n), *(F.get(w, i + k) for k in range(n)))))


def item_shingles(items: DataFrame, item_col: str, text_col: str, n: int) -> DataFrame:
    """(item, size, width, h): the distinct shingles of each item; width is the words of a shingle."""
    rows = items.select(F.col(item_col).alias("item"), word_list(F.col(text_col).cast("string")).alias("w")).where(F.size("w") > 0)
    rows = rows.withColumn("width", F.least(F.size("w"), F.lit(n)))
    hashes = shingle_hashes(F.col("w"), n)
    for k in range(n - 1, 0, -1):
        hashes = F.when(F.col("width") == k, shingle_hashes(F.col("w"), k)).otherwise(hashes)
    rows = rows.select("item", "width", hashes.alias("hs"))
    return rows.select("item", F.size("hs").alias("size"), "width", F.explode("hs").alias("h"))


def sketches(shingles: DataFrame, percent: int) -> DataFrame:
    """(h, item): the bottom-k shingles of each item, k by the item's size partition."""
    upper = F.pow(F.lit(2), F.floor(F.log2("size")) + 1) - 1
    k = F.floor(upper * (100 - percent) / 100) + 1
    order = Window.partitionBy("item", "size").orderBy(F.xxhash64("h", F.lit(17)), "h")
    return shingles.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("h", "item")


def find_contamination(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shingle: int = 5, percent: int = 75) -> DataFrame:
    """(id, item, n_shared, n_item, containment) for each document that holds ``percent`` of an item's shingles."""
    shared = _held(docs, items, id_col, text_col, item_col, item_text_col, shingle, percent)
    best = shared.groupBy("doc", "item").agg(F.max(F.struct((F.col("n") / F.col("size")).alias("c"), "n", "size")).alias("m"))
    return best.select(F.col("doc").alias(id_col), F.col("item").alias(item_col), F.col("m.n").cast("long").alias("n_shared"), F.col("m.size").cast("long").alias("n_item"), F.col("m.c").alias("containment"))


def _held(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, shingle: int, percent: int) -> DataFrame:
    """(doc, text_key, item, size, n): the items that each text of an id holds, and how many of their shingles."""
    known = materialize(item_shingles(items, item_col, item_text_col, shingle).distinct(), "items")
    small = is_small(known, BROADCAST_ROWS)
    hint = F.broadcast if small else (lambda x: x)
    widths = sorted(r["width"] for r in known.select("width").distinct().collect())  # at most ``shingle`` values
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))

    def exploded(source: DataFrame) -> DataFrame:
        w = source.select("doc", word_list(F.col("text")).alias("w"))
        parts = [shingle_hashes(F.col("w"), n) for n in widths] or [F.array().cast("array<bigint>")]
        return w.select("doc", F.explode(F.concat(*parts)).alias("h"))

    met = exploded(rows).join(hint(sketches(known, percent)), "h").select("doc", "item").distinct()
    met = materialize(met, "candidates")
    found = met.select(F.col("doc").alias("d")).distinct()
    texts = rows.join(F.broadcast(found) if is_small(met) else found, F.col("doc").eqNullSafe(F.col("d")), "left_semi")
    shared = _keyed(texts, widths).join(hint(known), "h").groupBy("doc", "text_key", "item", "size").agg(F.count("*").alias("n")).where(F.col("n") * 100 >= F.col("size") * percent)
    other = met.select(F.col("doc").alias("d"), F.col("item").alias("i"))
    return shared.join(hint(other) if is_small(met) else other, F.col("doc").eqNullSafe(F.col("d")) & F.col("item").eqNullSafe(F.col("i")), "left_semi")


def _keyed(texts: DataFrame, widths: list[int]) -> DataFrame:
    w = texts.select("doc", F.xxhash64("text").alias("text_key"), word_list(F.col("text")).alias("w")).dropDuplicates(["doc", "text_key"])
    parts = [shingle_hashes(F.col("w"), n) for n in widths] or [F.array().cast("array<bigint>")]
    return w.select("doc", "text_key", F.explode(F.concat(*parts)).alias("h"))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, item_col: str = "item_id", item_text_col: str = "text", shingle: int = 5, percent: int = 75) -> DataFrame:
    """``docs`` without the rows that hold an item."""
    gone = materialize(_held(docs, items, id_col, text_col, item_col, item_text_col, shingle, percent).select("doc", "text_key").distinct(), "contaminated")
    name, key = free(docs, "__gone_id"), free(docs, "__gone_text")
    side = gone.toDF(name, key)
    same = F.col(id_col).eqNullSafe(F.col(name)) & (F.xxhash64(F.col(text_col).cast("string")) == F.col(key))
    return docs.join(F.broadcast(side) if is_small(gone) else side, same, "left_anti")
