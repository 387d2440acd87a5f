"""Queries of metrics, losses, batches, histograms and episodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions import sequences as Q
from ..functions import images
from .registry import query, table

#: Three class scores of each labelled vector and a label, made from the vector's own numbers.
_P = "(SELECT vec_id, [embedding[1], embedding[2], embedding[3]]::DOUBLE[] AS p, (vec_id % 3)::INT AS y FROM embeddings)"
_B = f"(SELECT *, (list_position(p, list_max(p)) - 1)::INT AS c FROM {_P})"


def _scored(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.slice(F.col("embedding").cast("array<double>"), 1, 3).alias("p"), (F.col("vec_id") % 3).cast("int").alias("y"))


@query("accuracy", f"SELECT round(avg((c = y)::INT), 6) AS acc, round(avg((len(list_filter(p, lambda x: x > p[y + 1])) < 2)::INT), 6) AS top2 FROM {_B}")
def accuracy(spark, d):
    return _scored(spark, d).agg(F.round(M.accuracy("p", "y"), 6).alias("acc"), F.round(M.top_k_accuracy("p", "y", 2), 6).alias("top2"))


@query("confusion_matrix", f"SELECT a.i::INT AS label, b.i::INT AS predicted, (SELECT count(*) FROM {_B} WHERE y = a.i AND c = b.i) AS count FROM range(0, 3) a(i), range(0, 3) b(i)")
def confusion_matrix(spark, d):
    return M.confusion_matrix(_scored(spark, d), "p", "y", 3)


_C = f"(SELECT k, (SELECT count(*) FROM {_B} WHERE y = k AND c = k) AS tp, (SELECT count(*) FROM {_B} WHERE c = k) AS pr, (SELECT count(*) FROM {_B} WHERE y = k) AS ac FROM range(0, 3) t(k))"


@query("precision_recall_f1", f"SELECT round(avg(tp / pr), 6) AS pm, round(avg(tp / ac), 6) AS rm, round(avg(2 * tp / (pr + ac)), 6) AS fm, round(sum(tp) / sum(pr), 6) AS pi, round(2 * sum(tp) / sum(pr + ac), 6) AS fi FROM {_C}")
def precision_recall_f1(spark, d):
    t = _scored(spark, d)
    parts = [(M.precision, "macro", "pm"), (M.recall, "macro", "rm"), (M.f1, "macro", "fm"), (M.precision, "micro", "pi"), (M.f1, "micro", "fi")]
    out = None
    for f, average, name in parts:
        one = f(t, "p", "y", 3, average).select(F.round("value", 6).alias(name))
        out = one if out is None else out.crossJoin(one)
    return out


@query(
    "auc_roc",
    """WITH s AS (SELECT n_chars::DOUBLE AS s, quality AS y FROM labels JOIN documents USING (doc_id)), r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM s)
       SELECT round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 6) AS auc FROM r""",
)
def auc_roc(spark, d):
    t = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return M.auc_roc(t, "n_chars", "quality").select(F.round("auc", 6).alias("auc"))


@query(
    "losses",
    """SELECT round(avg((a - b) * (a - b)), 6) AS mse, round(avg(abs(a - b)), 6) AS mae, round(avg(CASE WHEN abs(a - b) <= 1 THEN 0.5 * (a - b) * (a - b) ELSE abs(a - b) - 0.5 END), 6) AS huber,
       round(avg(greatest(a, 0) - a * y + ln(1 + exp(-abs(a)))), 6) AS bce FROM (SELECT l_discount * 50 AS a, l_tax * 50 AS b, (l_linenumber % 2) AS y FROM lineitem)""",
)
def losses(spark, d):
    t = table(spark, d, "lineitem").select((F.col("l_discount") * 50).alias("a"), (F.col("l_tax") * 50).alias("b"), (F.col("l_linenumber") % 2).alias("y"))
    r = lambda x: F.round(M.reduced(x), 6)
    return t.agg(r(M.squared_error("a", "b")).alias("mse"), r(M.absolute_error("a", "b")).alias("mae"), r(M.huber("a", "b")).alias("huber"), r(M.sigmoid_bce("a", "y")).alias("bce"))


@query("cross_entropy", f"SELECT round(avg(ln(list_sum(list_transform(p, lambda x: exp(x)))) - p[y + 1]), 6) AS sparse, round(avg(ln(list_sum(list_transform(p, lambda x: exp(x)))) - 0.5 * p[1] - 0.5 * p[2]), 6) AS dense FROM {_P}")
def cross_entropy(spark, d):
    soft = F.array(F.lit(0.5), F.lit(0.5), F.lit(0.0))
    return _scored(spark, d).agg(F.round(F.avg(M.softmax_cross_entropy_sparse("p", "y")), 6).alias("sparse"), F.round(F.avg(M.softmax_cross_entropy("p", soft)), 6).alias("dense"))


@query("batches", "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 32 AS batch FROM labels")
def batches(spark, d):
    return M.batches(table(spark, d, "labels").select("doc_id"), 32, "doc_id")


@query("batches_drop_last", "SELECT batch, count(*) AS n FROM (SELECT (row_number() OVER (ORDER BY doc_id) - 1) // 32 AS batch FROM labels) GROUP BY 1 HAVING count(*) = 32")
def batches_drop_last(spark, d):
    """Shuffled batches are as large as others; which rows they hold is the seed's affair."""
    return M.batches(table(spark, d, "labels").select("doc_id"), 32, "doc_id", shuffle_seed=3, drop_last=True).groupBy("batch").agg(F.count("*").alias("n"))


@query("histogram", "WITH b AS (SELECT unnest(range(0, 10))::INT AS bin), c AS (SELECT least(floor((l_quantity - 1) / 4.9)::INT, 9) AS bin, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 1 AND 50 GROUP BY 1) SELECT bin, round(1 + bin * 4.9, 6)::DOUBLE AS left, coalesce(n, 0) AS count, round(coalesce(n, 0) / ((SELECT sum(n) FROM c) * 4.9), 8) AS density FROM b LEFT JOIN c USING (bin)")
def histogram(spark, d):
    t = M.histogram(table(spark, d, "lineitem"), "l_quantity", 10, 1.0, 50.0, density=True)
    return t.select("bin", F.round("left", 6).alias("left"), "count", F.round("density", 8).alias("density"))


@query("heatmap", "SELECT l_returnflag, l_linenumber, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY ALL")
def heatmap(spark, d):
    return M.heatmap(table(spark, d, "lineitem"), "l_returnflag", "l_linenumber", "l_quantity").withColumn("mean", F.round("mean", 6))


def _steps(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.col("value").cast("double").alias("reward"), (F.col("event_type") == "purchase").alias("terminated"))
    return e.withColumns({"truncated": F.lit(False), "value": F.col("reward") / 2})


@query(
    "returns",
    """WITH e AS (SELECT user_id, event_id, value::DOUBLE AS r, coalesce(sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM events),
       n AS (SELECT *, row_number() OVER (PARTITION BY user_id, seg ORDER BY event_id) AS k FROM e)
       SELECT event_id, round((SELECT sum(b.r * pow(1.0::DOUBLE / 3, b.k - a.k)) FROM n b WHERE b.user_id = a.user_id AND b.seg = a.seg AND b.k >= a.k), 6) AS ret FROM n a""",
)
def returns(spark, d):
    return Q.returns(_steps(spark, d), ["user_id"], "event_id", gamma=1 / 3, name="ret").select("event_id", F.round("ret", 6).alias("ret"))


@query(
    "gae",
    """WITH e AS (SELECT user_id, event_id, value::DOUBLE AS r, event_type = 'purchase' AS done, coalesce(sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg,
            coalesce(lead(value::DOUBLE / 2) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS after FROM events),
       n AS (SELECT *, row_number() OVER (PARTITION BY user_id, seg ORDER BY event_id) AS k, r + CASE WHEN done THEN 0 ELSE (2.0::DOUBLE / 3) * after END - r / 2 AS delta FROM e),
       g AS (SELECT event_id, r, (SELECT sum(b.delta * pow((2.0::DOUBLE / 3) * (6.0::DOUBLE / 7), b.k - a.k)) FROM n b WHERE b.user_id = a.user_id AND b.seg = a.seg AND b.k >= a.k) AS adv FROM n a)
       SELECT event_id, round(adv, 6) AS advantage, round(adv + r / 2, 6) AS "return" FROM g""",
)
def gae(spark, d):
    """Factors that don't end in decimals, so that no value lies on a rounding boundary."""
    return Q.gae(_steps(spark, d), ["user_id"], "event_id", gamma=2 / 3, lam=6 / 7).select("event_id", F.round("advantage", 6).alias("advantage"), F.round("return", 6).alias("return"))


@query("advantage_normalize", "SELECT event_id, round((value - (SELECT avg(value) FROM events)) / ((SELECT stddev_pop(value) FROM events) + 1e-8), 6) AS z FROM events")
def advantage_normalize(spark, d):
    return Q.normalize(table(spark, d, "events").select("event_id", "value"), "value", "z").select("event_id", F.round("z", 6).alias("z"))


@query("episode_stats", "SELECT count(*) AS episodes, round(avg(t), 4) AS mean_reward, round(stddev_pop(t), 4) AS std_reward, round(avg(n), 6) AS mean_length FROM (SELECT sum(value) AS t, count(*) AS n FROM events GROUP BY user_id)")
def episode_stats(spark, d):
    t = Q.episode_stats(table(spark, d, "events"), ["user_id"], "value")
    return t.select("episodes", F.round("mean_reward", 4).alias("mean_reward"), F.round("std_reward", 4).alias("std_reward"), F.round("mean_length", 6).alias("mean_length"))


@query(
    "rhat",
    """WITH c AS (SELECT user_id % 4 AS chain, event_id, value FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY chain) // 2 AS h FROM c),
       g AS (SELECT chain, i >= h AS s, avg(value) AS m, var_samp(value) AS v, count(*) AS n FROM n WHERE i < 2 * h GROUP BY ALL)
       SELECT round(sqrt(((avg(n) - 1) / avg(n) * avg(v) + var_samp(m)) / avg(v)), 8) AS rhat FROM g""",
)
def rhat(spark, d):
    t = table(spark, d, "events").select(F.lit("p").alias("param"), (F.col("user_id") % 4).alias("chain"), "event_id", "value")
    return Q.rhat(t, ["param"], "chain", "event_id", "value").select(F.round("rhat", 8).alias("rhat"))


@query(
    "ess",
    """WITH c AS (SELECT user_id % 4 AS chain, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) AS i, value::DOUBLE - avg(value::DOUBLE) OVER (PARTITION BY user_id % 4) AS x, count(*) OVER (PARTITION BY user_id % 4) AS n FROM events),
       l AS (SELECT a.chain, b.i - a.i AS k, any_value(a.n) AS n, sum(a.x * b.x) AS s FROM c a JOIN c b ON a.chain = b.chain AND b.i >= a.i GROUP BY 1, 2),
       p AS (SELECT o.chain, o.n, o.k, (o.s + e.s) / z.s AS pair FROM l o JOIN l e ON e.chain = o.chain AND e.k = o.k + 1 JOIN l z ON z.chain = o.chain AND z.k = 0 WHERE o.k % 2 = 1 AND o.k < o.n - 1),
       f AS (SELECT *, min(CASE WHEN pair < 0 THEN k END) OVER (PARTITION BY chain) AS stop FROM p)
       SELECT chain, round(any_value(n) / greatest(1 + 2 * coalesce(sum(pair) FILTER (stop IS NULL OR k < stop), 0), 1e-12), 4) AS ess FROM f GROUP BY 1""",
)
def ess(spark, d):
    t = table(spark, d, "events").select((F.col("user_id") % 4).alias("chain"), "event_id", F.col("value").cast("double").alias("value"))
    return Q.ess(t, ["chain"], "event_id", "value").withColumn("ess", F.round("ess", 4))


@query("replay_buffer", "SELECT 100::BIGINT AS n, min(event_id) AS oldest FROM (SELECT event_id FROM events ORDER BY event_id DESC LIMIT 100)")
def replay_buffer(spark, d):
    b = Q.ReplayBuffer(100, "event_id").add(table(spark, d, "events").select("event_id", "value"))
    return b.frame.agg(F.count("*").alias("n"), F.min("event_id").alias("oldest"))


def _images(spark, d):
    """Eight vectors an image, their numbers in rows of it."""
    t = table(spark, d, "embeddings").select((F.col("vec_id") / 8).cast("int").alias("image"), (F.col("vec_id") % 8).cast("int").alias("y"), F.posexplode(F.col("embedding").cast("array<double>")).alias("x", "v"))
    return t


_IMAGES = "(SELECT (vec_id // 8)::INT AS image, (vec_id % 8)::INT AS y, unnest(range(0, len(embedding)))::INT AS x, unnest(embedding)::DOUBLE AS v FROM embeddings)"


@query("image_box_blur_whole", f"WITH p AS {_IMAGES} SELECT a.image, a.y, a.x, round(sum(b.v) / 9, 6) + 0 AS v FROM p a JOIN p b ON a.image = b.image AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL")
def image_box_blur_whole(spark, d):
    return images.box_blur(_images(spark, d), 3).withColumn("v", F.round("v", 6))


@query("image_morphology_whole", f"WITH p AS {_IMAGES} SELECT a.image, a.y, a.x, round(max(b.v) - min(b.v), 6) + 0 AS v FROM p a JOIN p b ON a.image = b.image AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL")
def image_morphology_whole(spark, d):
    return images.morphological_gradient(_images(spark, d), images.structuring_element("rect", 3)).withColumn("v", F.round("v", 6))


@query("image_flip_crop_whole", f"WITH p AS {_IMAGES} SELECT image, y - 2 AS y, (63 - x) - 1 AS x, v FROM p WHERE y BETWEEN 2 AND 5 AND 63 - x BETWEEN 1 AND 6")
def image_flip_crop_whole(spark, d):
    return images.crop(images.hflip(_images(spark, d), 64), 2, 1, 4, 6).select("image", "y", "x", "v")
