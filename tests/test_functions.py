import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brindle.functions import arrays as V
from brindle.functions import calculus, coo, images, linalg, metrics, optim, sequences
from brindle.functions import scalar as S


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def vec(*x):
    return F.array(*(F.lit(float(v)) for v in x))


def test_ieee(spark):
    lit = lambda x: F.lit(float(x))
    got = one(spark, S.div(lit(1), lit(0)), S.div(lit(-1), lit(0)), S.div(lit(1), lit("-0.0")), S.log(lit(0)), S.minimum(lit("nan"), lit(1)), S.equal(lit("nan"), lit("nan")), S.round_(lit(-2.5)), S.trunc(lit(-2.7)), S.sigmoid(lit(-800)))
    assert got[0] == math.inf and got[1] == -math.inf and got[2] == -math.inf and got[3] == -math.inf and math.isnan(got[4]) and got[5] is False and got[6] == -3.0 and got[7] == -2.0 and got[8] == 0.0
    assert math.isnan(one(spark, S.div(lit(0), lit(0)))[0]) and math.isnan(one(spark, S.log(lit(-1)))[0])
    assert one(spark, S.erf(lit(0.5)))[0] == pytest.approx(math.erf(0.5))


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-100, 100, allow_nan=False), min_size=1, max_size=12))
def test_arrays_agree_with_numpy(spark, x):
    a = np.array(x)
    v = vec(*x)
    got = one(spark, V.sum_(v), V.mean(v), V.var(v), V.max_(v), V.argmax(v), V.argmin(v), V.cumsum(v), V.sort(v), V.argsort(v), V.roll(v, 3), V.softmax(v), V.norm(v), V.argsort(v, True), V.logsumexp(v))
    near = lambda g, e: np.testing.assert_allclose(g, e, rtol=1e-9, atol=1e-9)
    near(got[0], a.sum()), near(got[1], a.mean()), near(got[2], a.var()), near(got[3], a.max())
    assert got[4] == a.argmax() and got[5] == a.argmin()
    near(got[6], a.cumsum()), near(got[7], np.sort(a)), near(got[9], np.roll(a, 3)), near(got[11], np.linalg.norm(a))
    assert got[8] == np.argsort(a, kind="stable").tolist() and got[12] == np.argsort(-a, kind="stable").tolist()
    e = np.exp(a - a.max())
    near(got[10], e / e.sum()), near(got[13], a.max() + np.log(e.sum()))


def test_array_movement(spark):
    v = vec(1, 2, 3, 4, 5)
    got = one(spark, V.slice_(v, 1, -1, 2), V.take(v, [-1, 0]), V.take(v, [7], "wrap"), V.take(v, [9], "clip"), V.put(v, [0, 0], [7.0, 8.0]), V.split(v, 2), V.correlate(v, vec(1, 1), "same"), V.convolve(v, vec(1, 2)), V.tile(vec(1, 2), 2), V.repeat(vec(1, 2), 2), V.transpose(F.array(vec(1, 2), vec(3, 4))))
    assert got[0] == [2.0, 4.0] and got[1] == [5.0, 1.0] and got[2] == [3.0] and got[3] == [5.0] and got[4][0] == 8.0
    assert got[5] == [[1.0, 2.0, 3.0], [4.0, 5.0]] and len(got[6]) == 5 and got[7] == np.convolve([1, 2, 3, 4, 5], [1, 2], "valid").tolist()
    assert got[8] == [1.0, 2.0, 1.0, 2.0] and got[9] == [1.0, 1.0, 2.0, 2.0] and got[10] == [[1.0, 3.0], [2.0, 4.0]]
    assert one(spark, V.scatter(F.array(F.lit(0), F.lit(2), F.lit(2)), vec(1, 2, 3), 3, "add"))[0] == [1.0, 0.0, 5.0]
    assert one(spark, V.scatter(F.array(F.lit(0), F.lit(2), F.lit(2)), vec(1, 2, 3), 3))[0] == [1.0, 0.0, 3.0]


def cells(spark, m):
    return spark.createDataFrame([(i, j, float(v)) for i, r in enumerate(m) for j, v in enumerate(r)], "i long, j long, v double")


def dense(df, shape):
    out = np.zeros(shape)
    for r in df.collect():
        out[tuple(r[:-1])] = r[-1]
    return out


def test_long_form_products(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(3, 4)), rng.normal(size=(4, 2))
    ta, tb = cells(spark, a), cells(spark, b)
    np.testing.assert_allclose(dense(coo.matmul(ta, tb), (3, 2)), a @ b)
    np.testing.assert_allclose(dense(coo.einsum("ij,ij->i", ta, ta), (3,)), (a * a).sum(1))
    np.testing.assert_allclose(dense(coo.einsum("ij->ji", ta), (4, 3)), a.T)
    np.testing.assert_allclose(dense(coo.kron(ta, tb, 4, 2), (12, 8)), np.kron(a, b))
    s = a[:3, :3]
    np.testing.assert_allclose(dense(coo.matrix_power(cells(spark, s), 5, 3), (3, 3)), np.linalg.matrix_power(s, 5))
    np.testing.assert_allclose(coo.einsum("ii", cells(spark, s)).first()[0], np.trace(s))
    np.testing.assert_allclose(dense(coo.tril(ta, -1), (3, 4)), np.tril(a, -1))


def test_linear_algebra(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(3, 3)), rng.normal(size=3)
    t = spark.createDataFrame([(a.tolist(), b.tolist()), (np.zeros((3, 3)).tolist(), b.tolist())], "a array<array<double>>, b array<double>")
    got = t.select(linalg.det("a").alias("d"), linalg.solve("a", "b").alias("x"), linalg.svdvals("a").alias("s"), linalg.matrix_rank("a").alias("r"), linalg.slogdet("a").alias("l")).collect()
    np.testing.assert_allclose(got[0]["d"], np.linalg.det(a))
    np.testing.assert_allclose(got[0]["x"], np.linalg.solve(a, b))
    np.testing.assert_allclose(got[0]["s"], np.linalg.svd(a, compute_uv=False))
    assert got[1]["x"] is None and got[1]["r"] == 0
    x = spark.createDataFrame([([1.0, 2.0, 0.5, -1.0],)], "x array<double>")
    for kind in (1, 2, 3, 4):
        back = x.select(linalg.idct(kind)(linalg.dct(kind)("x"))).first()[0]
        np.testing.assert_allclose(back, [1.0, 2.0, 0.5, -1.0], atol=1e-9)
        back = x.select(linalg.idst(kind)(linalg.dst(kind)("x"))).first()[0]
        np.testing.assert_allclose(back, [1.0, 2.0, 0.5, -1.0], atol=1e-9)
    z = x.select(linalg.fft("x")).first()[0]
    np.testing.assert_allclose([complex(v["re"], v["im"]) for v in z], np.fft.fft([1.0, 2.0, 0.5, -1.0]), atol=1e-12)


def test_metrics_literal(spark):
    t = spark.createDataFrame([([5.0, 1.0, 0.0], 0), ([0.0, 2.0, 1.0], 1), ([0.0, 1.0, 9.0], 2), ([3.0, 2.0, 1.0], 2)], "p array<double>, y int")
    assert t.agg(metrics.accuracy("p", "y")).first()[0] == 0.75
    assert t.agg(metrics.top_k_accuracy("p", "y", 3)).first()[0] == 1.0
    assert {(r[0], r[1]): r[2] for r in metrics.confusion_matrix(t, "p", "y", 3).collect()}[(2, 0)] == 1
    assert metrics.f1(t, "p", "y", 3, "micro").first()[0] == 0.75
    with pytest.raises(ValueError):
        metrics.check_labels(t.withColumn("y", F.lit(3)), "p", "y")
    s = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1)], "s double, y int")
    assert metrics.auc_roc(s, "s", "y").first()[0] == 0.75
    assert metrics.auc_roc(s.withColumn("s", F.lit(1.0)), "s", "y").first()[0] == 0.5
    assert math.isnan(metrics.auc_roc(s.where("y = 1"), "s", "y").first()[0])


def test_recurrences(spark):
    t = spark.createDataFrame([(0, 0, 1.0, 0.5, False, False), (0, 1, 2.0, 1.0, True, False), (0, 2, 3.0, 0.0, False, True), (0, 3, 4.0, 2.0, False, False)], "env int, t int, reward double, value double, terminated boolean, truncated boolean")
    got = [r["return"] for r in sequences.returns(t, ["env"], "t", gamma=0.5).orderBy("t").collect()]
    assert got == [2.0, 2.0, 3.0, 4.0]
    adv = [r["advantage"] for r in sequences.gae(t, ["env"], "t", gamma=1.0, lam=1.0).orderBy("t").collect()]
    assert adv == [2.5, 1.0, 5.0, 2.0]
    rng = np.random.default_rng(0)
    assert 500 < sequences.autocorrelation_ess(rng.normal(size=1000)) < 1600
    b = sequences.ReplayBuffer(2, "t").add(t)
    assert b.is_full() and {r["t"] for r in b.frame.collect()} == {2, 3} and b.sample(5).count() == 2


def test_schedules_and_steps(spark):
    t = spark.createDataFrame([(1.0, 0.5, 0.0, 0.0)], "p double, g double, m double, v double")
    assert optim.adam(t, 0.1, 1).first()["p"] == pytest.approx(0.9)
    assert optim.sgd(t, 0.1).first()["p"] == pytest.approx(0.95)
    assert one(spark, optim.cosine_decay(F.lit(50), 1.0, 100))[0] == pytest.approx(0.5)
    assert one(spark, optim.piecewise_constant(F.lit(3), [3], [1.0, 2.0]))[0] == 1.0
    assert optim.adjust_loss_scale(8.0, 5, False) == (4.0, 0)
    assert one(spark, optim.traced(vec(1, 1, 1), 0.5))[0] == [1.0, 1.5, 1.75]


def test_derivatives(spark):
    f = lambda x: np.sum(np.sin(x) * x**2) + np.exp(x[0])
    g = lambda x: (np.sin(x) * x**2).sum() + np.exp(x[0])
    x = np.array([0.3, 1.2])
    assert calculus.check_grads(g, x) and f(x) == pytest.approx(g(x))
    h = calculus.hessian(lambda x: (x * x).sum() * 0.5, x)
    np.testing.assert_allclose(h, np.eye(2), atol=1e-5)
    t = spark.createDataFrame([(1.0, 2.0), (2.0, 3.0)], "a double, b double")
    value, grad = calculus.table_gradient(t, ["a", "b"], lambda p, m: ((m[:, 0] * p[0] - m[:, 1]) ** 2).sum(), np.array([1.0]))
    assert value == pytest.approx(2.0) and grad[0] == pytest.approx(-6.0)


def test_images(spark):
    img = np.random.default_rng(5).random((5, 6))
    t = spark.createDataFrame([(0, y, x, float(img[y, x])) for y in range(5) for x in range(6)], "image int, y int, x int, v double")
    plane = lambda df: dense(df.select("y", "x", "v"), (5, 6))
    padded = np.pad(img, 1)
    box = sum(padded[i : i + 5, j : j + 6] for i in range(3) for j in range(3)) / 9
    np.testing.assert_allclose(plane(images.box_blur(t, 3)), box)
    np.testing.assert_allclose(plane(images.hflip(t, 6)), img[:, ::-1])
    median = np.median(np.stack([padded[i : i + 5, j : j + 6] for i in range(3) for j in range(3)]), 0)
    np.testing.assert_allclose(plane(images.median_blur(t, 3)), median)
    rgb = spark.createDataFrame([(0.2, 0.5, 0.9), (0.3, 0.3, 0.3)], "r double, g double, b double")
    back = images.hsv_to_rgb(images.rgb_to_hsv(rgb)).collect()
    np.testing.assert_allclose([list(r) for r in back], [[0.2, 0.5, 0.9], [0.3, 0.3, 0.3]], atol=1e-12)


def test_optimiser_chains_follow_numpy_over_steps(spark):
    rng = np.random.default_rng(5)
    p, m, v = rng.normal(size=6), np.zeros(6), np.zeros(6)
    df = spark.createDataFrame([(i, i // 3, float(x), 0.0, 0.0) for i, x in enumerate(p)], "i int, tensor int, p double, m double, v double")
    for step in (1, 2, 3):
        g = rng.normal(size=6)
        df = df.withColumn("g", F.element_at(vec(*g), F.col("i") + 1))
        df = optim.apply_updates(df, optim.lamb(lambda k: optim.constant(0.1 / k), by=["tensor"]), step)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        u = m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8) + 0.01 * p
        ratio = np.repeat([np.linalg.norm(p[k : k + 3]) / (np.linalg.norm(u[k : k + 3]) + 1e-6) for k in (0, 3)], 3)
        p = p - 0.1 / step * ratio * u
        df = spark.createDataFrame(df.drop("g").collect(), "tensor int, i int, p double, m double, v double")
    assert [r["p"] for r in df.orderBy("i").collect()] == pytest.approx(p.tolist())


def test_steps_that_are_not_finite_change_nothing(spark):
    rows = [(0, 1.0, 2.0, 0.5, 0), (0, 1.0, math.inf, 0.5, 0), (1, 1.0, 2.0, 0.5, 3), (2, 1.0, None, 0.5, 0)]
    df = spark.createDataFrame(rows, "tensor int, p double, g double, t double, bad int")
    step = optim.apply_if_finite(optim.chain(optim.trace(0.5), optim.scale_by_learning_rate(0.1)), ["t"], ["tensor"])
    got = {(r["tensor"], r["p"], r["t"], r["bad"]) for r in optim.apply_updates(df, step, 1).collect()}
    assert got == {(0, 1.0, 0.5, 1), (1, 1.0 - 0.1 * 2.25, 2.25, 0), (2, None, None, 0)}


def test_lars_takes_momentum_decay_and_trust(spark):
    df = spark.createDataFrame([(3.0, 1.0, 2.0), (4.0, -1.0, 0.0)], "p double, g double, t double")
    got = [r["p"] for r in optim.apply_updates(df, optim.lars(0.1), 1).orderBy("p").collect()]
    p, t = np.array([3.0, 4.0]), 0.9 * np.array([2.0, 0.0]) + np.array([1.0, -1.0])
    u = t + 0.01 * p
    assert got == pytest.approx(sorted(p - 0.1 * u * 5 / (np.linalg.norm(u) + 1e-6)))


def test_along_axis_and_equality(spark):
    cells = lambda m, kind="double": spark.createDataFrame([(i, j, x) for i, r in enumerate(m) for j, x in enumerate(r)], f"i int, j int, v {kind}")
    t = cells([[4.0, 1.0, 2.0], [3.0, 5.0, 6.0]])
    taken = coo.take_along_axis(t, cells([[1, 0], [0, 9]], "int"), "j")
    assert sorted(map(tuple, taken.collect())) == [(0, 0, 1.0), (0, 1, 4.0), (1, 0, 3.0)]
    put = coo.put_along_axis(t, cells([[1, 1], [0, 2]], "int"), cells([[7.0, 8.0], [9.0, 0.0]]), "j")
    assert coo.array_equal(put, cells([[4.0, 8.0, 2.0], [9.0, 5.0, 0.0]])).first()["equal"]
    for other in ([[4.0, 1.0, 2.0]], [[4.0, 1.0, 2.0], [3.0, 5.0, math.nan]]):
        assert not coo.array_equal(t, cells(other)).first()["equal"]
        assert not coo.array_equal(cells(other), t).first()["equal"]
    assert coo.array_equal(t.limit(0), t.limit(0)).first()["equal"]
    got = one(spark, V.array_equal(vec(1, 2), vec(1, 2)), V.array_equal(vec(1), vec(1, 2)), V.array_equal(vec("nan"), vec("nan")), V.array_equal(F.array(), F.array()), V.broadcast_to(vec(1, 2), 2))
    assert tuple(got) == (True, False, False, True, [[1.0, 2.0], [1.0, 2.0]])


def test_categorical_draws_by_probability(spark):
    t = spark.range(20_000).select(V.categorical(vec(math.log(0.7), math.log(0.2), math.log(0.1)), F.col("id"), 3).alias("k"))
    n = {r["k"]: r["count"] / 20_000 for r in t.groupBy("k").count().collect()}
    assert n[0] == pytest.approx(0.7, abs=0.02) and n[1] == pytest.approx(0.2, abs=0.02) and n[2] == pytest.approx(0.1, abs=0.02)


def test_transforms_along_several_axes(spark):
    x = np.random.default_rng(2).normal(size=(3, 4))
    m, flat = F.array(*(vec(*r) for r in x)), vec(*x.ravel())
    z = lambda v: np.array([complex(c["re"], c["im"]) for c in v])
    got = one(spark, linalg.fft2(m), linalg.rfft2(m), linalg.irfft2(linalg.rfft2(m)), linalg.ifft2(linalg.fft2(m)), linalg.fftn(flat, (3, 2, 2)), linalg.ifftn(linalg.fftn(flat, (3, 2, 2)), (3, 2, 2)), linalg.irfftn(linalg.rfftn(flat, (2, 3, 2)), (2, 3, 2)), linalg.dctn(flat, (3, 4)), linalg.idctn(linalg.dctn(flat, (3, 4)), (3, 4)), linalg.idstn(linalg.dstn(flat, (3, 4)), (3, 4)))
    assert np.allclose([z(r) for r in got[0]], np.fft.fft2(x)) and np.allclose([z(r) for r in got[1]], np.fft.rfft2(x))
    assert np.allclose(got[2], x) and np.allclose([z(r) for r in got[3]], x)
    assert np.allclose(z(got[4]), np.fft.fftn(x.reshape(3, 2, 2)).ravel())
    assert np.allclose(z(got[5]), x.ravel()) and np.allclose(got[6], x.ravel())
    k = lambda n: 2 * np.cos(np.pi * np.arange(n)[:, None] * (2 * np.arange(n)[None, :] + 1) / (2 * n))
    assert np.allclose(got[7], (k(3) @ x @ k(4).T).ravel())
    assert np.allclose(got[8], x.ravel()) and np.allclose(got[9], x.ravel())


def test_einsum_chain_joins_the_small_operands_first(spark, monkeypatch):
    a = np.random.default_rng(5).normal(size=(300, 4))
    t = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(300) for j in range(4)], "i long, j long, v double")
    kept, summed = [], coo._summed
    monkeypatch.setattr(coo, "_summed", lambda x, keep: kept.append(sorted(keep)) or summed(x, keep))
    found = np.zeros((300, 4))
    for r in coo.einsum("ab,cb,cd->ad", t, t, t).collect():
        found[r[0], r[1]] = r[2]
    np.testing.assert_allclose(found, a @ a.T @ a)
    assert kept == [["b", "d"], ["a", "d"]]  # never a row for each two rows


def bits(v):
    return math.copysign(1, v), v


def test_rounding_keeps_the_sign_of_zero(spark):
    got = spark.createDataFrame([(-3e-7,), (-0.0,), (0.0,), (3e-7,), (-1.25,), (math.inf,)], "x double").select(S.round_to("x", 1)).collect()
    assert [bits(r[0]) for r in got] == [(-1, 0), (-1, 0), (1, 0), (1, 0), (-1, -1.3), (1, math.inf)]


def test_patches_correlate_and_ieee_division_agree_with_sql_in_negative_zeros(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    vectors = [(1, [-5e-7, 0.0, 0.0, 1.0, 2.0, 3.0, 4.0, 5.0], 0), (2, [0.0, 0.0, 1e-9, -1e-8, 0.0, 0.0, -0.5, 0.5], 1)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.range(1, 31).select(F.col("id").alias("o_orderkey")).write.parquet(f"{tmp_path}/orders.parquet")
    for name, table, key in (("patches_correlate", "embeddings", "vec_id"), ("ieee_division", "orders", "o_orderkey")):
        c = duckdb.connect()
        c.execute(f"create view {table} as select * from read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
        want = [str(r) for r in c.execute(f"select * from ({entry.oracle_sql()[name]}) order by {key}").fetchall()]
        rows = entry.queries()[name](spark, str(tmp_path)).orderBy(key).collect()
        assert "-0.0" in str(want) and [str(tuple(r)) for r in rows] == want
