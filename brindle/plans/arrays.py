"""Queries of the scalar, array and long-form functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as V
from ..functions import coo, linalg, optim
from ..functions import scalar as S
from ..operators import ordered
from .registry import query, table


def _line(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("q"), F.col("l_discount").alias("s"))


def _elementwise(name: str, functions: dict, sql: dict, digits: int = 6) -> None:
    columns = ", ".join(f"round(({e})::DOUBLE, {digits}) AS {n}" for n, e in sql.items())

    @query(name, f"SELECT l_orderkey, l_linenumber, {columns} FROM (SELECT *, l_extendedprice AS x, l_quantity AS q, l_discount AS s FROM lineitem)")
    def f(spark, d):
        return _line(spark, d).select("l_orderkey", "l_linenumber", *(F.round(v().cast("double"), digits).alias(n) for n, v in functions.items()))


_elementwise(
    "math_unary",
    {"ab": lambda: S.abs_(-F.col("x")), "sg": lambda: S.sign(F.col("s") - 0.05), "sq": lambda: S.square("q"), "rt": lambda: S.sqrt("x"), "rr": lambda: S.rsqrt("q"), "rc": lambda: S.recip("q"), "lg": lambda: S.log("x"), "l2": lambda: S.log2("x"), "ex": lambda: S.exp("s"), "e2": lambda: S.exp2("s"), "ne": lambda: S.neg("x")},
    {"ab": "abs(-x)", "sg": "sign(s - 0.05)", "sq": "q * q", "rt": "sqrt(x)", "rr": "1 / sqrt(q)", "rc": "1 / q", "lg": "ln(x)", "l2": "log2(x)", "ex": "exp(s)", "e2": "pow(2, s)", "ne": "-x"},
)
_elementwise(
    "math_trigonometry",
    {"a": lambda: S.sin("q"), "b": lambda: S.cos("q"), "c": lambda: S.tan("s"), "e": lambda: S.asin("s"), "f": lambda: S.acos("s"), "g": lambda: S.atan("q"), "h": lambda: S.sinh("s"), "i": lambda: S.cosh("s"), "j": lambda: S.tanh("s"), "k": lambda: S.asinh("q"), "m": lambda: S.acosh("q"), "n": lambda: S.atanh("s")},
    {"a": "sin(q)", "b": "cos(q)", "c": "tan(s)", "e": "asin(s)", "f": "acos(s)", "g": "atan(q)", "h": "sinh(s)", "i": "cosh(s)", "j": "tanh(s)", "k": "asinh(q)", "m": "acosh(q)", "n": "atanh(s)"},
)
_elementwise(
    "math_rounding",
    {"fl": lambda: S.floor("x"), "ce": lambda: S.ceil("x"), "tr": lambda: S.trunc(-F.col("x")), "ro": lambda: S.round_(F.col("q") / 2)},
    {"fl": "floor(x)", "ce": "ceil(x)", "tr": "-floor(x)", "ro": "floor(q / 2 + 0.5)"},
)
_elementwise(
    "math_binary",
    {"a": lambda: S.add("x", "q"), "b": lambda: S.sub("x", "q"), "c": lambda: S.mul("q", "s"), "e": lambda: S.div("x", "q"), "f": lambda: S.pow_("q", "s"), "g": lambda: S.mod(F.col("q").cast("long"), F.lit(7)), "h": lambda: S.atan2("q", "x"), "i": lambda: S.hypot("q", "s"), "j": lambda: S.lerp("q", "x", "s"), "k": lambda: S.clamp("q", 10.0, 30.0), "m": lambda: S.maximum("q", F.col("s") * 300), "n": lambda: S.minimum("q", F.col("s") * 300)},
    {"a": "x + q", "b": "x - q", "c": "q * s", "e": "x / q", "f": "pow(q, s)", "g": "q::BIGINT % 7", "h": "atan2(q, x)", "i": "sqrt(q * q + s * s)", "j": "q + s * (x - q)", "k": "least(greatest(q, 10), 30)", "m": "greatest(q, s * 300)", "n": "least(q, s * 300)"},
    8,
)
_elementwise(
    "activations",
    {"a": lambda: S.relu(F.col("q") - 25), "b": lambda: S.leaky_relu(F.col("q") - 25, 0.1), "c": lambda: S.sigmoid(F.col("q") - 25), "e": lambda: S.silu(F.col("q") - 25), "f": lambda: S.softplus(F.col("q") - 25), "g": lambda: S.gelu_approx(F.col("s"))},
    {"a": "greatest(q - 25, 0)", "b": "CASE WHEN q > 25 THEN q - 25 ELSE 0.1 * (q - 25) END", "c": "1 / (1 + exp(25 - q))", "e": "(q - 25) / (1 + exp(25 - q))", "f": "ln(1 + exp(-abs(q - 25))) + greatest(q - 25, 0)", "g": "0.5 * s * (1 + tanh(sqrt(2 / pi()) * (s + 0.044715 * s * s * s)))"},
)


@query("ieee_division", "SELECT o_orderkey, CASE WHEN a = 0 AND b = 0 THEN 'NaN'::DOUBLE WHEN b = 0 AND a > 0 THEN 'Infinity'::DOUBLE WHEN b = 0 THEN '-Infinity'::DOUBLE ELSE round(a / b, 6) END AS dv, CASE WHEN a < 0 THEN 'NaN'::DOUBLE WHEN a = 0 THEN '-Infinity'::DOUBLE ELSE round(ln(a), 6) END AS lg FROM (SELECT o_orderkey, (o_orderkey % 5 - 2)::DOUBLE AS a, (o_orderkey % 3 - 1)::DOUBLE AS b FROM orders)")
def ieee_division(spark, d):
    t = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 5 - 2).cast("double").alias("a"), (F.col("o_orderkey") % 3 - 1).cast("double").alias("b"))
    return t.select("o_orderkey", S.round_to(S.div("a", "b"), 6).alias("dv"), S.round_to(S.log("a"), 6).alias("lg"))


@query("int_div_mod", "SELECT o_orderkey, ((o_orderkey % 17 - 8) // 3)::BIGINT AS q, ((o_orderkey % 17 - 8) % 3)::BIGINT AS r FROM orders")
def int_div_mod(spark, d):
    a = F.col("o_orderkey") % 17 - 8
    return table(spark, d, "orders").select("o_orderkey", S.int_div(a, F.lit(3)).alias("q"), S.mod(a, F.lit(3)).alias("r"))


@query("compare_logic", "SELECT event_id, value > 50 AS gt, value <= 50 AS le, value <> 0 AND event_id % 2 <> 0 AS an, value <> 0 OR event_id % 2 <> 0 AS o, (value <> 0) <> (event_id % 2 <> 0) AS xo, event_id % 2 = 0 AS no, CASE WHEN value > 50 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w FROM events")
def compare_logic(spark, d):
    odd = F.col("event_id") % 2
    return table(spark, d, "events").select("event_id", S.greater("value", F.lit(50)).alias("gt"), S.less_equal("value", F.lit(50)).alias("le"), S.logical_and("value", odd).alias("an"), S.logical_or("value", odd).alias("o"), S.logical_xor("value", odd).alias("xo"), S.logical_not(odd).alias("no"), S.where(F.col("value") > 50, F.lit(1.0), F.lit(2.0)).alias("w"))


@query("nan_family", "SELECT event_id, event_id % 3 = 0 AS n, event_id % 3 = 1 AS i, event_id % 3 = 2 AS f, event_id % 3 <> 0 AS eq FROM events")
def nan_family(spark, d):
    m = F.col("event_id") % 3
    x = F.when(m == 0, float("nan")).when(m == 1, float("inf")).otherwise(F.col("value").cast("double"))
    return table(spark, d, "events").select("event_id", S.isnan(x).alias("n"), S.isinf(x).alias("i"), S.isfinite(x).alias("f"), S.equal(x, x).alias("eq"))


@query("bitwise", "SELECT o_orderkey, o_orderkey & 12 AS a, o_orderkey | 12 AS o, xor(o_orderkey, 12) AS x, ~o_orderkey AS n, o_orderkey << 2 AS l, o_orderkey >> 2 AS r FROM orders")
def bitwise(spark, d):
    k, m = F.col("o_orderkey"), F.lit(12).cast("long")
    return table(spark, d, "orders").select("o_orderkey", S.bitwise_and(k, m).alias("a"), S.bitwise_or(k, m).alias("o"), S.bitwise_xor(k, m).alias("x"), S.bitwise_not(k).alias("n"), S.lshift(k, 2).alias("l"), S.rshift(k, 2).alias("r"))


_E = "(SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)"


def _vec(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))


@query(
    "vector_reduce",
    f"""SELECT vec_id, round(list_sum(e), 5) AS s, round(list_avg(e), 6) AS m, round(list_max(e), 6) AS hi, round(list_min(e), 6) AS lo, round(list_var_pop(e), 6) AS v,
      round(list_stddev_pop(e), 6) AS sd, (list_position(e, list_max(e)) - 1)::INT AS am, (list_position(e, list_min(e)) - 1)::INT AS an,
      len(list_filter(e, lambda x: x = 0)) = 0 AS al, len(list_filter(e, lambda x: x <> 0)) > 0 AS ay FROM {_E}""",
)
def vector_reduce(spark, d):
    return _vec(spark, d).select("vec_id", F.round(V.sum_("e"), 5).alias("s"), F.round(V.mean("e"), 6).alias("m"), F.round(V.max_("e"), 6).alias("hi"), F.round(V.min_("e"), 6).alias("lo"), F.round(V.var("e"), 6).alias("v"), F.round(V.std("e"), 6).alias("sd"), V.argmax("e").cast("int").alias("am"), V.argmin("e").cast("int").alias("an"), V.all_("e").alias("al"), V.any_("e").alias("ay"))


@query(
    "vector_products",
    f"""SELECT vec_id, round(list_dot_product(e, e), 5) AS dt, round(sqrt(list_dot_product(e, e)), 5) AS l2, round(list_sum(list_transform(e, lambda x: abs(x))), 5) AS l1,
      round(list_max(list_transform(e, lambda x: abs(x))), 6) AS li, round(list_dot_product(e, list_reverse(e)) / list_dot_product(e, e), 5) AS cs FROM {_E}""",
)
def vector_products(spark, d):
    return _vec(spark, d).select("vec_id", F.round(V.dot("e", "e"), 5).alias("dt"), F.round(V.norm("e"), 5).alias("l2"), F.round(V.norm("e", 1), 5).alias("l1"), F.round(V.norm("e", float("inf")), 6).alias("li"), F.round(V.cosine("e", V.flip("e")), 5).alias("cs"))


@query(
    "vector_softmax",
    f"""SELECT vec_id, unnest(list_transform(e, lambda x: round(exp(x - m) / s, 6))) AS p, unnest(list_transform(e, lambda x: round(x - m - ln(s), 5))) AS lp, round(m + ln(s), 5) AS lse,
      round(m + ln(s) - ln(len(e)), 5) AS lme FROM (SELECT *, list_sum(list_transform(e, lambda x: exp(x - m))) AS s FROM (SELECT *, list_max(e) AS m FROM {_E}))""",
)
def vector_softmax(spark, d):
    t = _vec(spark, d).select("vec_id", V.softmax("e").alias("p"), V.log_softmax("e").alias("lp"), F.round(V.logsumexp("e"), 5).alias("lse"), F.round(V.logmeanexp("e"), 5).alias("lme"))
    t = t.select("vec_id", "lse", "lme", F.explode(F.arrays_zip("p", "lp")).alias("z"))
    return t.select("vec_id", F.round("z.p", 6).alias("p"), F.round("z.lp", 5).alias("lp"), "lse", "lme")


@query("vector_standardize", f"SELECT vec_id, unnest(list_transform(e, lambda x: round((x - list_avg(e)) / sqrt(list_var_pop(e) + 1e-5), 5))) AS z FROM {_E}")
def vector_standardize(spark, d):
    return _vec(spark, d).select("vec_id", F.explode(V.standardize("e")).alias("z")).select("vec_id", F.round("z", 5).alias("z"))


@query("vector_sort", f"SELECT vec_id, list_sort(e)[1:3] AS lo, list_reverse_sort(e)[1:3] AS hi, list_transform(list_grade_up(e)[1:3], lambda i: (i - 1)::INT) AS at FROM {_E}")
def vector_sort(spark, d):
    return _vec(spark, d).select("vec_id", F.slice(V.sort("e"), 1, 3).alias("lo"), V.top_k("e", 3).alias("hi"), F.slice(V.argsort("e"), 1, 3).alias("at"))


@query(
    "vector_movement",
    f"""SELECT vec_id, list_reverse(e)[1:2] AS fl, list_concat(e[-2:], e[:-3])[1:3] AS ro, list_concat([0.0, 0.0], e[1:2]) AS pd, e[3:5] AS sh, list_concat(e[1:2], e[1:2]) AS ti,
      [e[1], e[1], e[2], e[2]] AS re, [e[6], e[1], e[6]] AS tk FROM {_E}""",
)
def vector_movement(spark, d):
    two = F.slice("e", 1, 2)
    return _vec(spark, d).select("vec_id", F.slice(V.flip("e"), 1, 2).alias("fl"), F.slice(V.roll("e", 2), 1, 3).alias("ro"), V.pad(two, 2, 0, 0.0).alias("pd"), V.shrink("e", 2, 5).alias("sh"), V.tile(two, 2).alias("ti"), V.repeat(two, 2).alias("re"), V.take("e", [5, 0, 5]).alias("tk"))


@query("vector_cumulative", f"SELECT vec_id, unnest(range(0, len(e)))::INT AS i, unnest(list_transform(range(1, len(e) + 1), lambda i: round(list_sum(e[1:i]), 5))) AS s, unnest(list_transform(range(1, len(e) + 1), lambda i: round(list_max(e[1:i]), 6))) AS hi FROM {_E}")
def vector_cumulative(spark, d):
    t = _vec(spark, d).select("vec_id", F.posexplode(F.arrays_zip(V.cumsum("e").alias("s"), V.cummax("e").alias("hi"))).alias("i", "z"))
    return t.select("vec_id", "i", F.round("z.s", 5).alias("s"), F.round("z.hi", 6).alias("hi"))


@query("one_hot", "SELECT vec_id, list_transform(range(0, 10), lambda i: (i = label)::TINYINT) AS h FROM embeddings")
def one_hot(spark, d):
    return table(spark, d, "embeddings").select("vec_id", V.one_hot("label", 10).alias("h"))


@query("patches_correlate", f"SELECT vec_id, [e[1:4], e[5:8]] AS pt, list_transform(range(1, 4), lambda i: round(e[i] * 0.5 + e[i + 1] + e[i + 2] * 0.25, 6)) AS co, [list_max(e[1:4]), list_max(e[5:8])] AS mx FROM {_E}")
def patches_correlate(spark, d):
    eight = F.slice("e", 1, 8)
    k = F.array(F.lit(0.5), F.lit(1.0), F.lit(0.25))
    return _vec(spark, d).select("vec_id", V.extract_patches(eight, 4, 4).alias("pt"), F.transform(V.correlate(F.slice("e", 1, 5), k), lambda x: S.round_to(x, 6)).alias("co"), V.maximum_filter(eight, 4).alias("mx"))


@query("nonzero_compress", "SELECT vec_id, list_transform(list_filter(range(0, len(embedding)), lambda i: embedding[i + 1] > 0.2), lambda i: i::INT) AS at, list_filter(embedding, lambda x: x > 0.2) AS v FROM embeddings")
def nonzero_compress(spark, d):
    mask = F.transform("embedding", lambda x: x > F.lit(0.2).cast("float"))
    return table(spark, d, "embeddings").select("vec_id", V.nonzero(F.transform(mask, lambda m: m.cast("int"))).alias("at"), V.compress("embedding", mask).alias("v"))


@query("reduce_axes", "SELECT j::INT AS j, round(sum(v), 4) AS s, round(avg(v), 6) AS m, round(min(v), 6) AS lo, round(max(v), 6) AS hi, round(var_pop(v), 6) AS va FROM (SELECT unnest(range(0, len(embedding))) AS j, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY 1")
def reduce_axes(spark, d):
    t = coo.from_vectors(_vec(spark, d), "vec_id", "e")
    out = t.groupBy("j").agg(F.round(F.sum("v"), 4).alias("s"), F.round(F.avg("v"), 6).alias("m"), F.round(F.min("v"), 6).alias("lo"), F.round(F.max("v"), 6).alias("hi"), F.round(F.var_pop("v"), 6).alias("va"))
    return out


@query("meshgrid", "SELECT a.r_regionkey AS x, b.r_regionkey AS y FROM region a, region b")
def meshgrid(spark, d):
    r = table(spark, d, "region")
    return coo.meshgrid(r.select(F.col("r_regionkey").alias("x")), r.select(F.col("r_regionkey").alias("y")))


@query("linspace_arange", "SELECT unnest(list_transform(range(0, 11), lambda i: round(i * 0.1, 6)::DOUBLE)) AS l, unnest(range(5, 27, 2))::INT AS a")
def linspace_arange(spark, d):
    z = spark.range(1).select(F.explode(F.arrays_zip(V.linspace(0, 1, 11).alias("l"), V.arange(5, 27, 2).alias("a"))).alias("z"))
    return z.select(F.round("z.l", 6).alias("l"), F.col("z.a").cast("int").alias("a"))


@query("sliding_whole", "SELECT event_id, max(value) OVER w AS hi, min(value) OVER w AS lo, round(avg(value) OVER w, 6) AS m FROM events WINDOW w AS (ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)")
def sliding_whole(spark, d):
    def make(w):
        f = w.rowsBetween(-2, 1)
        return {"hi": F.max("value").over(f), "lo": F.min("value").over(f), "m": F.round(F.avg("value").over(f), 6)}

    return ordered.framed(table(spark, d, "events").select("event_id", "value"), "event_id", 2, 1, make).select("event_id", "hi", "lo", "m")


@query("linear_algebra")
def linear_algebra(spark, d):
    """Determinant, rank, singular values and a solution of each vector's own Gram matrix."""
    m = _vec(spark, d).select("vec_id", V.reshape(F.slice("e", 1, 16), 4, 4).alias("m"), F.slice("e", 17, 4).alias("b"))
    return m.select("vec_id", linalg.det("m").alias("det"), linalg.matrix_rank("m").alias("rank"), linalg.svdvals("m").alias("sv"), linalg.solve("m", "b").alias("x"), linalg.inv("m").alias("inv"))


@query("fourier_round_trip", f"SELECT vec_id, round(list_sum(e), 4) AS s FROM {_E}")
def fourier_round_trip(spark, d):
    t = _vec(spark, d).select("vec_id", linalg.irfft(linalg.rfft("e")).alias("back"))
    return t.select("vec_id", F.round(V.sum_("back"), 4).alias("s"))


@query("least_squares", "SELECT round(regr_slope(l_extendedprice, l_quantity), 3) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept FROM lineitem")
def least_squares(spark, d):
    a, b = linalg.least_squares(table(spark, d, "lineitem"), ["l_quantity"], "l_extendedprice")
    return spark.createDataFrame([(round(float(a), 3), round(float(b), 2))], "slope double, intercept double")


@query("schedules", "SELECT i AS step, CASE WHEN i >= 100 THEN 0.0 ELSE round(1 - i / 100.0, 6) END::DOUBLE AS lin, CASE WHEN i >= 100 THEN 0.0 ELSE round(0.5 * (1 + cos(pi() * i / 100)), 6) END::DOUBLE AS co, round(pow(0.5, i / 50.0), 6) AS ex, CASE WHEN i <= 30 THEN 1.0 WHEN i <= 60 THEN 0.5 ELSE 0.1 END::DOUBLE AS pw FROM range(0, 120) t(i)")
def schedules(spark, d):
    s = F.col("step")
    t = spark.range(120).withColumnRenamed("id", "step")
    return t.select("step", F.round(optim.linear(s, 1.0, 0.0, 100), 6).alias("lin"), F.round(optim.cosine_decay(s, 1.0, 100), 6).alias("co"), F.round(optim.exponential_decay(s, 1.0, 0.5, 50), 6).alias("ex"), optim.piecewise_constant(s, [30, 60], [1.0, 0.5, 0.1]).alias("pw"))


@query("global_norm_clip", "SELECT l_orderkey, l_linenumber, round(l_discount * least(1.0, 5.0 / (SELECT sqrt(sum(l_discount * l_discount)) FROM lineitem)), 8) AS g FROM lineitem")
def global_norm_clip(spark, d):
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").alias("g"))
    return optim.clip_by_global_norm(t, 5.0).withColumn("g", F.round("g", 8))


@query("adam_step", "SELECT l_orderkey, l_linenumber, round(l_quantity - 0.1 * l_discount / (l_discount + 1e-8), 6) AS p FROM lineitem")
def adam_step(spark, d):
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("p"), F.col("l_discount").alias("g"), F.lit(0.0).alias("m"), F.lit(0.0).alias("v"))
    return optim.adam(t, 0.1, 1).select("l_orderkey", "l_linenumber", F.round("p", 6).alias("p"))


# Long-form queries over all components of all vectors.

_TALL = "(SELECT vec_id AS i, unnest(range(0, len(embedding))) AS j, unnest(embedding)::DOUBLE AS v FROM embeddings)"
#: The Gram matrix of the vectors' components, square.
_GRAM = f"(SELECT x.j AS i, y.j AS j, sum(x.v * y.v) AS v FROM {_TALL} x JOIN {_TALL} y ON x.i = y.i GROUP BY ALL)"


def _tall(spark, d):
    return coo.from_vectors(_vec(spark, d), "vec_id", "e").withColumn("j", F.col("j").cast("long"))


def _gram(spark, d):
    a = _tall(spark, d)
    return coo.einsum("ki,kj->ij", a, a)


@query("matmul_whole", f"SELECT i, j AS k, round(v, 4) + 0 AS v FROM {_GRAM}")
def matmul_whole(spark, d):
    a = _tall(spark, d)
    return coo.matmul(coo.transpose(a).select("i", "j", "v"), a).withColumn("v", F.round("v", 4))


@query("einsum_trace_of_product_whole", f"SELECT round(sum(x.v * y.v), 3) + 0 AS v FROM {_TALL} x JOIN {_TALL} y ON x.i = y.i AND x.j = y.j")
def einsum_trace_of_product_whole(spark, d):
    a = _tall(spark, d)
    return coo.einsum("ij,ji->", a, coo.transpose(a).select("i", "j", "v")).withColumn("v", F.round("v", 3))


@query("einsum_chain_whole", f"WITH g AS {_GRAM} SELECT x.i AS a, y.j AS d, round(sum(x.v * y.v), 3) + 0 AS v FROM {_TALL} x JOIN g y ON x.j = y.i GROUP BY ALL")
def einsum_chain_whole(spark, d):
    a = _tall(spark, d)
    return coo.einsum("ab,cb,cd->ad", a, a, a).withColumn("v", F.round("v", 3))


@query("trace_diagonal_whole", f"WITH a AS {_GRAM} SELECT round(sum(v) FILTER (i = j), 3) AS tr, round(sum(v) FILTER (j - i <= -1), 3) AS lower, round(sum(v) FILTER (j - i >= 1), 3) AS upper, round(sum(v) FILTER (i + 1 = j), 3) AS off FROM a")
def trace_diagonal_whole(spark, d):
    a = _gram(spark, d)
    one = lambda t, n: t.agg(F.round(F.sum("v"), 3).alias(n))
    return one(coo.trace(a), "tr").crossJoin(one(coo.tril(a, -1), "lower")).crossJoin(one(coo.triu(a, 1), "upper")).crossJoin(one(coo.diagonal(a, 1), "off"))


@query("outer_product_whole", f"WITH a AS {_TALL} SELECT x.i, y.i AS j, round(x.v * y.v, 6) + 0 AS v FROM (SELECT i, v FROM a WHERE j = 0) x, (SELECT j AS i, sum(v) AS v FROM a GROUP BY 1) y")
def outer_product_whole(spark, d):
    """Of the first components and the sums of all: as many rows as the table has cells."""
    a = _tall(spark, d)
    sums = coo.reduce_axes(a, ["j"]).withColumnRenamed("j", "i")
    return coo.outer(coo.slice_axis(a, "j", 0, 1).select("i", "v"), sums).withColumn("v", F.round("v", 6))


@query("tensor_reshape_roll_whole", f"WITH a AS {_TALL} SELECT ((i * 64 + j) // 4)::BIGINT AS i, (((i * 64 + j) % 4 + 1) % 4)::BIGINT AS j, v FROM a")
def tensor_reshape_roll_whole(spark, d):
    return coo.roll(coo.reshape(_tall(spark, d), 64, 4), "j", 1, 4)


@query("matrix_norms_whole", f"WITH a AS {_TALL} SELECT round(sqrt(sum(v * v)), 4) AS fro, (SELECT round(max(s), 4) FROM (SELECT sum(abs(v)) AS s FROM a GROUP BY j)) AS one, (SELECT round(max(s), 4) FROM (SELECT sum(abs(v)) AS s FROM a GROUP BY i)) AS inf FROM a")
def matrix_norms_whole(spark, d):
    a = _tall(spark, d)
    parts = [coo.norm(a, k).select(F.round("v", 4).alias(n)) for k, n in (("fro", "fro"), ("1", "one"), ("inf", "inf"))]
    return parts[0].crossJoin(parts[1]).crossJoin(parts[2])


@query("take_along_axis", f"SELECT i, max(v) AS v FROM {_TALL} GROUP BY i")
def take_along_axis(spark, d):
    """The values at the positions of the largest ones."""
    a = _tall(spark, d)
    at = coo.arg_extreme(a, ["i"], "j").select("i", F.lit(0).cast("long").alias("j"), F.col("j").alias("v"))
    return coo.take_along_axis(a, at, "j").select("i", "v")


@query("put_along_axis", f"SELECT i, j, CASE WHEN j = min(j) FILTER (v = m) OVER (PARTITION BY i) THEN 0 ELSE v END AS v FROM (SELECT *, max(v) OVER (PARTITION BY i) AS m FROM {_TALL})")
def put_along_axis(spark, d):
    """The first of the largest values of each vector becomes 0."""
    a = _tall(spark, d)
    at = coo.arg_extreme(a, ["i"], "j").select("i", F.lit(0).cast("long").alias("j"), F.col("j").alias("v"))
    return coo.put_along_axis(a, at, at.withColumn("v", F.lit(0.0)), "j")


_STEP = "(SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity::DOUBLE AS p, l_discount::DOUBLE AS g FROM lineitem)"


def _parameters(spark, d, *state):
    t = table(spark, d, "lineitem")
    return t.select("l_orderkey", "l_linenumber", "l_returnflag", F.col("l_quantity").cast("double").alias("p"), F.col("l_discount").cast("double").alias("g"), *(F.lit(0.0).alias(s) for s in state))


@query(
    "lamb_step",
    f"""WITH u AS (SELECT *, g / (abs(g) + 1e-8) + 0.01 * p AS u FROM {_STEP}), n AS (SELECT l_returnflag, sqrt(sum(p * p)) AS a, sqrt(sum(u * u)) AS b FROM u GROUP BY 1)
       SELECT l_orderkey, l_linenumber, round(p - 0.1 * u * a / (b + 1e-6), 4) AS p FROM u JOIN n USING (l_returnflag)""",
)
def lamb_step(spark, d):
    t = optim.apply_updates(_parameters(spark, d, "m", "v"), optim.lamb(0.1, by=["l_returnflag"]), 1)
    return t.select("l_orderkey", "l_linenumber", F.round("p", 4).alias("p"))


@query("adan_step", f"SELECT l_orderkey, l_linenumber, round(p - 0.1 * ((0.02 + 0.92 * 0.08) * g / (0.1 * 1.92 * abs(g) + 1e-8) + 0.02 * p), 6) AS p FROM {_STEP}")
def adan_step(spark, d):
    t = optim.apply_updates(_parameters(spark, d, "m", "d", "n", "prev"), optim.adan(0.1), 1)
    return t.select("l_orderkey", "l_linenumber", F.round("p", 6).alias("p"))


@query("momentum_chain", f"SELECT l_orderkey, l_linenumber, round(p - 0.1 * (least(greatest(g, -0.05), 0.05) * 1.9 + 0.01 * p), 6) AS p FROM {_STEP}")
def momentum_chain(spark, d):
    steps = optim.chain(optim.clip_updates(0.05), optim.trace(nesterov=True), optim.add_decayed_weights(), optim.scale_by_learning_rate(0.1))
    return optim.apply_updates(_parameters(spark, d, "t"), steps, 1).select("l_orderkey", "l_linenumber", F.round("p", 6).alias("p"))
