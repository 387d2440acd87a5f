import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import common, embeddings, neardup, substring
from brindle.llm.common import components

from .helpers import SCHEMA, classes, documents, shingles


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (3, 1), (5, 5)] + [(100 + i, 101 + i) for i in range(20)], "a long, b long")
    got = {r[0]: r[1] for r in components(e, "a", "b").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8} | {100 + i: 100 for i in range(21)}
    assert components(e.limit(0), "a", "b").count() == 0


@pytest.mark.parametrize("small", [0, 6])
def test_near_duplicates_agree_with_brute_force(spark, small):
    docs = documents(spark)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    sets = {i: shingles(t) for i, t in texts.items()}
    linked = lambda a, b: bool(sets[a]) and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    want = classes(list(texts), linked)
    got = neardup.near_duplicates(docs.withColumn("component_id", F.lit("clash")), small=small).collect()
    assert len(got) == docs.count()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {(i, len(sets[i]), c, i == c) for i, c in want.items()}


def test_tiles_find_what_leaders_miss(spark):
    """Chains of near copies whose ends aren't similar: one component, though few are linked with the leader."""
    rng = np.random.default_rng(2)
    w = [f"w{i}" for i in range(100)]
    texts = []
    for k in range(60):
        texts.append(" ".join(w))
        w = list(w)
        w[int(rng.integers(100))] = f"n{k}"
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA)
    assert {r["component_id"] for r in neardup.near_duplicates(docs, small=2).collect()} == {0}


def test_tiles_hold_one_list_each(spark, monkeypatch):
    """Lists that share sets with one another aren't chained: what tiles compare grows with the longest list, not with the table."""
    rng = np.random.default_rng(5)
    words = lambda n: " ".join(f"w{x}" for x in rng.integers(10**6, size=n))
    lines = [words(12) for _ in range(17)]
    texts = [f"{lines[i]} {lines[i + 1]} {words(14)}" for i in range(16) for _ in range(8)]
    texts += [t.rsplit(" ", 1)[0] + " other" for t in texts[::9]]
    sets = [shingles(t) for t in texts]
    seen, whole, tiles = [], [], neardup._tiles

    def tapped(rows, *rest):
        if "set" not in rows.columns:
            seen.append(rows.groupBy("grp").count().agg(F.max("count")).first()[0])
            whole.append(rows.select("id").distinct().count())
        return tiles(rows, *rest)

    monkeypatch.setattr(neardup, "_tiles", tapped)
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs).collect()}
    assert got == classes(range(len(texts)), lambda a, b: 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]))
    assert seen and max(seen) <= 2 * 8 + 4 < max(whole) // 2  # a line stands in 16 texts and their few copies


@pytest.mark.parametrize("same", [False, True])
def test_tiles_of_near_copies_take_little_memory(same):
    """Two full blocks in which all is alike: their pairs are never held at once, and the forests join what is linked."""
    rng = np.random.default_rng(3)
    n = neardup.BLOCK_ROWS
    base = np.sort(rng.integers(2**63, size=80, dtype=np.uint64))
    sets = [np.unique(np.concatenate([base[:k], rng.integers(2**63, size=80 - k, dtype=np.uint64)])) for k in rng.integers(60, 80, size=2 * n)]
    ids, sig = np.arange(2 * n), np.ones((2 * n, 32), np.int32)
    left = ids[:n], ids[:n], sig[:n], sets[:n]
    right = left if same else (ids[n:], ids[n:], sig[n:], sets[n:])
    tracemalloc.start()
    x, y = neardup._alike(left, right, 12, same)
    a, b = neardup._tile_links(left, right, 12, 75, same)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 128 << 20
    assert set(x.tolist()) == {0} and len(y) == (n if same else 2 * n) - 1
    # Sets of k and m of the base share min(k, m) of it: with the longest on the other side is each one's best chance.
    shared = [len(np.intersect1d(s, base)) for s in sets]
    sides = [range(n), range(n) if same else range(n, 2 * n)]
    best = [max(sides[1], key=shared.__getitem__), max(sides[0], key=shared.__getitem__)]
    linked = lambda i, j: 100 * min(shared[i], shared[j]) >= 75 * (len(sets[i]) + len(sets[j]) - min(shared[i], shared[j]))
    want = {i for side, top in zip(sides, best, strict=True) for i in side if i != top and linked(i, top)}
    assert want <= {*a.tolist(), *b.tolist()}


def test_near_duplicates_edge_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert neardup.near_duplicates(empty).count() == 0 and neardup.keep_one(empty).columns == empty.columns
    odd = spark.createDataFrame([(None, "a b c d e", "en", "s", 9), (1, "a b c d e", "en", "s", 9), (2, None, None, None, None)], SCHEMA)
    got = {r["doc_id"]: (r["component_id"], r["kept"]) for r in neardup.near_duplicates(odd).collect()}
    assert got == {None: (None, True), 1: (1, True), 2: (2, True)}
    docs = documents(spark)
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() < docs.count()
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) == neardup.near_duplicates(docs).where("kept").select("doc_id").distinct().count()
    two = spark.createDataFrame([(1, "a b c d e f", "en", "s", 1), (1, "u v w x y z", "en", "s", 2), (1, "a b c d e f", "en", "s", 3), (None, None, "en", "s", 4), (None, None, "en", "s", 4)], SCHEMA).withColumn("__near_id", F.lit(0))
    assert sorted(r["n_chars"] for r in neardup.keep_one(two).collect())[1:] == [2, 4, 4] and neardup.keep_one(two).count() == 4


def test_components_of_hubs(spark):
    rows = [(7, 1000 + i) for i in range(12_000)] + [(1000 + 3 * i, 50_000 + i) for i in range(2_000)] + [(5, 50_000), (90_001, 90_000), (90_002, 90_001), (8, 8)]
    got = dict(map(tuple, common.components(spark.createDataFrame(rows, "a long, b long"), "a", "b", hub_edges=1000).collect()))
    nodes = {x for r in rows for x in r} - {8}
    assert got == {n: 90_000 if n >= 90_000 else 5 for n in nodes}


def cosines(x):
    n = np.sqrt((x * x).sum(1))
    return x @ x.T / np.outer(n, n)


def test_embeddings_agree_with_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK_BYTES", 64 * 8 * 16)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 16))
    x = (centres[rng.integers(0, 6, 300)] + 0.28 * rng.normal(size=(300, 16))).astype(np.float32)
    x[10] = x[11] = x[12]
    x[20] = x[21] * 2
    label = rng.integers(0, 2, 300)
    label[10:13] = 0
    rows = [(i, x[i].tolist(), int(label[i])) for i in range(300)]
    rows += [(300, None, 0), (301, [], 0), (302, [0.0] * 16, 0), (303, [float("nan")] * 16, 0), (304, [None] * 16, 0), (305, x[0].tolist(), None), (306, x[0].tolist()[:8], 0), rows[5]]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    c = cosines(x.astype(np.float64)) >= 0.93
    link = c & (label[:, None] == label) & ~np.eye(300, dtype=bool)
    want = classes(list(range(300)), lambda a, b: link[a, b])
    got = embeddings.near_duplicates(t).collect()
    assert len(got) == len(rows)
    for r in got:
        i = r["vec_id"]
        if i < 300:
            assert (r["n_links"], r["component_id"], r["kept"]) == (int(link[i].sum()), want[i], want[i] == i)
        else:
            assert (r["n_links"], r["component_id"], r["kept"]) == (0, i, True)
    assert embeddings.near_duplicates(t.limit(0)).count() == 0


def test_quantisation_bound_holds():
    rng = np.random.default_rng(4)
    u, v = (x / np.sqrt((x * x).sum(1))[:, None] for x in (rng.normal(size=(200, 24)), rng.normal(size=(200, 24))))
    (qu, su, eu), (qv, sv, ev) = embeddings.quantise(u), embeddings.quantise(v)
    near = (qu.astype(float) @ qv.astype(float).T) * np.outer(su, sv)
    bound = eu[:, None] * (1 + ev) + ev * (1 + eu[:, None]) + eu[:, None] * ev
    assert (np.abs(near - u @ v.T) <= bound).all()


def test_compact_windows_are_cartesian_nodes():
    rng = np.random.default_rng(1)
    for _ in range(60):
        rows = [rng.integers(0, 2**63, rng.integers(0, 30), dtype=np.uint64) for _ in range(3)]
        starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
        length = int(rng.integers(1, 8))
        got = set(zip(*(x.tolist() for x in substring.compact_windows(np.concatenate(rows), starts, length)), strict=True))
        want = set()
        for k, r in enumerate(rows):
            for p in range(len(r)):
                low, high = p, p
                while low and r[low - 1] > r[p]:
                    low -= 1
                while high + 1 < len(r) and r[high + 1] > r[p]:
                    high += 1
                if high - low + 1 >= length:
                    want.add((k, p, low, high))
        assert got == want


def test_passages_cover_all_repeated_runs(spark):
    docs = documents(spark)
    texts = {r["doc_id"]: (r["text"] or "").encode().lower().split() for r in docs.collect()}
    seen = {}
    for i, w in texts.items():
        for k in range(len(w) - 49):
            seen.setdefault(tuple(w[k : k + 50]), set()).add(i)
    got = substring.repeated_passages(docs.withColumn("class_id", F.lit("clash"))).collect()
    spans = {}
    for r in got:
        spans.setdefault(r["doc_id"], []).append((r["start_word"], r["end_word"]))
        assert r["n_words"] >= 50
    runs = [(i, k) for i, w in texts.items() for k in range(len(w) - 49) if len(seen[tuple(w[k : k + 50])]) > 1]
    covered = [any(s <= k and k + 50 <= e for s, e in spans.get(i, [])) for i, k in runs]
    assert {i for i, _ in runs} <= set(spans)
    # Of the group of near copies a run may be missed that no leader has; verbatim passages and copies are whole.
    assert all(c for (i, _), c in zip(runs, covered, strict=True) if not 25 <= i < 50) and sum(covered) >= 0.9 * len(covered)
    quiet = {i for i, w in texts.items() if len(w) == 4000}
    assert not quiet & set(spans)
    heads = [r for r in got if r["kept"]]
    assert all((r["doc_id"], r["start_word"]) == (r["class_id"], r["class_start"]) for r in heads)
    assert substring.repeated_passages(docs.limit(0)).count() == 0
    cut = substring.cut_passages(docs, substring.repeated_passages(docs))
    assert cut.columns == docs.columns and cut.count() == docs.count()


def test_every_run_that_two_texts_share_is_found_and_classed(spark):
    """Also in a group of near copies with many edits, where neither leaders nor neighbours have it."""
    docs = documents(spark, 6)
    texts = {r["doc_id"]: (r["text"] or "").encode().lower().split() for r in docs.collect()}
    places = {}
    for i, w in texts.items():
        for k in range(len(w) - 49):
            places.setdefault(tuple(w[k : k + 50]), []).append((i, k))
    places = [p for p in places.values() if len({i for i, _ in p}) > 1]
    found = substring.repeated_passages(docs).collect()
    spans = {}
    for r in found:
        spans.setdefault(r["doc_id"], []).append(r)
    for p in places:
        classes = [[(r["class_id"], r["class_start"]) for r in spans.get(i, []) if r["start_word"] <= k and k + 50 <= r["end_word"]] for i, k in p]
        assert all(classes) and len({c for cs in classes for c in cs}) == 1
    assert len(places) > 50


def test_shared_runs_are_those_of_a_plain_search(spark):
    """Repetitive texts, runs of exactly the least length, repeats within a text, and keys that are joined by broadcast."""
    rng = np.random.default_rng(4)
    texts = [[f"w{x}" for x in rng.integers(0, 2 if i < 3 else 10**9, rng.integers(5, 60))] for i in range(12)]
    run = texts[5][:12] if len(texts[5]) > 11 else [f"r{i}" for i in range(12)]
    texts += [[f"a{i}", *run, f"b{i}"] for i in range(4)] + [run[:11] + ["z"], ["x"] * 40, ["x"] * 30 + run + ["y"] + run, ["q"] * 50]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "id long, text string")
    places = {}
    for i, w in enumerate(texts):
        for k in range(len(w) - 11):
            places.setdefault(tuple(w[k : k + 12]), []).append((i, k))
    want = {x for p in places.values() if len({i for i, _ in p}) > 1 for x in p}
    for hot in (None, 1):
        rows = substring.shared_runs(docs, 12, hot).collect()
        got = {(r[c], k) for r in rows for c in "ab" for k in range(r[f"start_{c}"], r[f"end_{c}"] - 11)}
        assert want <= got and {i for i, _ in got} == {i for i, _ in want}
        assert all((r["a"], r["start_a"]) < (r["b"], r["start_b"]) for r in rows if r["end_b"] - r["start_b"] == 12)
        words = {x for i, k in want for x in ((i, k + j) for j in range(12))}
        assert {(i, k + j) for i, k in got for j in range(12)} == words


def test_alignment_bridges_edits():
    a = np.arange(100, dtype=np.uint64)
    b = a.copy()
    b[50:55] = 10**6 + np.arange(5, dtype=np.uint64)
    assert substring.align(a, b, 46, 75) == [(0, 100, 0, 100)]
    assert substring.align(a[:40], b, 46, 75) == []
    assert substring.align(a, np.concatenate([b[60:], a[:46]]), 46, 75) == [(0, 46, 40, 86)]


def test_alignment_sees_runs_of_repetitive_texts():
    rng = np.random.default_rng(8)
    for _ in range(30):
        a, b = (rng.integers(0, 4, 60).astype(np.uint64) for _ in range(2))
        b[5:25] = a[30:50]
        covered = np.zeros(60, bool)
        for s, e, _, _ in substring.align(a, b, 12, 75):
            covered[s:e] = True
        runs = [i for i in range(49) if any((a[i : i + 12] == b[j : j + 12]).all() for j in range(49))]
        assert runs and all(covered[i : i + 12].all() for i in runs)


def test_second_leaders_serve_texts_that_have_found_something(spark, monkeypatch):
    """A run that the first leader lacks is found under one hash function, though both texts share another passage with that leader."""
    rng = np.random.default_rng(5)
    fresh = lambda n: [f"u{rng.integers(10**12)}" for _ in range(n)]
    common, run = fresh(60), fresh(60)
    texts = [common + fresh(60), common + fresh(20) + run, run + fresh(10) + common]
    docs = spark.createDataFrame([(i, " ".join(w), "en", "s", 1) for i, w in enumerate(texts)], SCHEMA)
    windows = spark.createDataFrame([(7, 32 * i, i, i, 40, 0, len(w) - 5) for i, w in enumerate(texts)], substring._ROW)
    monkeypatch.setattr(substring, "heavy_values", lambda *_: {})
    monkeypatch.setattr(substring, "post_windows", lambda *_: windows)
    assert {(r["a"], r["b"]) for r in substring.candidates(windows, 1, 46, 75).collect()} == {(0, 1), (0, 2), (1, 2)}
    spans = {(r["doc_id"], r["start_word"], r["end_word"]) for r in substring.repeated_passages(docs).collect()}
    assert spans == {(0, 0, 60), (1, 0, 60), (1, 80, 140), (2, 0, 60), (2, 70, 130)}


def test_windows_meet_the_same_way_however_they_are_dealt(spark, monkeypatch):
    """Partitions, batches and parts of heavy values change neither the pairs of ordinary values nor the passages."""
    docs = documents(spark, 6).union(documents(spark, 7).withColumn("doc_id", F.col("doc_id") + 1000))
    unique = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text")).where("doc_id is not null").dropDuplicates(["text"])
    found = []
    for parts, batch in ((1, 10_000), (7, 16), (211, 3)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            met = substring.candidates(substring.post_windows(unique.repartition(parts), 4, 46), 1, 46, 75)
            found.append({tuple(r) for r in met.collect()})
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
            spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert found[0] == found[1] == found[2] and len(found[0]) > 25
    whole = {tuple(r) for r in substring.repeated_passages(docs).collect()}
    monkeypatch.setattr(substring, "SAMPLE_LEAST", 2)
    monkeypatch.setattr(substring, "PART_ROWS", 2)
    assert substring.heavy_values(unique, unique.count(), 4, 46)
    dealt = {tuple(r) for r in substring.repeated_passages(docs).collect()}
    at = lambda rows: {r[0] for r in rows}
    # Leaders of parts of two rows are others; a group of near copies with many edits may lose a text.
    assert {i for i in at(whole) ^ at(dealt) if not 25 <= i % 1000 < 50} == set() and len(at(whole) ^ at(dealt)) <= 2


def test_bulk_alignment_agrees_with_that_of_pairs():
    rng = np.random.default_rng(3)
    fresh = lambda n: rng.integers(10**6, 2**62, n).astype(np.uint64)
    base = [fresh(rng.integers(50, 120)) for _ in range(3)]
    base.append(np.concatenate([x := fresh(30), fresh(5), x, x]))
    rows, group = [], []
    for g, a in enumerate(base):
        for _ in range(12):
            b = np.concatenate([fresh(rng.integers(0, 9)), a[rng.integers(0, 20) : rng.integers(60, 120)], fresh(rng.integers(0, 9))])
            for _ in range(rng.integers(0, 3)):
                at = rng.integers(0, len(b))
                b = np.concatenate([b[:at], fresh(rng.integers(0, 6)), b[at + rng.integers(0, 6) :]])
            rows.append(b)
            group.append(g)
    firsts = substring._Firsts(base, [5, 0, 7, 0])
    la, ra = firsts.low[group] + 2, firsts.low[group] + [len(base[g]) - 3 for g in group]
    starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    row, s, e, t, u, plain = substring._plain(firsts, np.concatenate(rows), starts, np.array(group), la, ra, 46, 75)
    assert 10 < plain.sum() < len(rows) and len(row)
    for k, b in enumerate(rows):
        got = sorted(zip(*(x[row == k].tolist() for x in (s, e, t, u)), strict=True))
        low = firsts.low[group[k]]
        want = [(x + la[k], y + la[k], v, w) for x, y, v, w in substring.align(base[group[k]][la[k] - low : ra[k] + 1 - low], b, 46, 75)]
        assert got == (want if plain[k] else [])


def test_alignment_finds_every_place_on_either_side():
    rng = np.random.default_rng(9)
    fresh = lambda n: rng.integers(10**6, 2**62, n).astype(np.uint64)
    p = fresh(20)
    many = np.concatenate([x for _ in range(5) for x in (fresh(7), p)])
    one = np.concatenate([fresh(9), p, fresh(9)])
    for a, b in ((one, many), (many, one)):
        got = substring.align(a, b, 12, 75)
        for x, y, side in ((a, b, 0), (b, a, 2)):
            covered = np.zeros(len(x), bool)
            for r in got:
                covered[r[side] : r[side + 1]] = True
            assert (covered == np.isin(x, y)).all()
    for _ in range(30):  # repetitive texts
        a, b = (rng.integers(0, 3, 80).astype(np.uint64) for _ in range(2))
        b[5:25], b[40:60] = a[30:50], a[30:50]
        got = substring.align(a, b, 12, 75)
        for x, y, side in ((a, b, 0), (b, a, 2)):
            runs = [i for i in range(69) if any((x[i : i + 12] == y[k : k + 12]).all() for k in range(69))]
            assert runs and all(any(r[side] <= i and i + 12 <= r[side + 1] for r in got) for i in runs)
    assert substring.exact_runs(p, many, 12, np.zeros(20, bool)) == [(0, 20, 7, 27)]


def test_passages_of_a_class_are_named_by_its_first_one_for_any_id(spark):
    passage = " ".join(f"p{i}" for i in range(70))
    ids = [-(2**63), -7, 0, 5, 2**63 - 1]
    docs = spark.createDataFrame([(i, f"{' '.join(f'w{k}_{j}' for j in range(k * 9))} {passage} end{k}") for k, i in enumerate(ids)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in substring.repeated_passages(docs).collect()}
    assert sorted(found) == ids
    assert {(r["class_id"], r["class_start"]) for r in found.values()} == {(ids[0], 0)}
    assert [i for i in ids if found[i]["kept"]] == ids[:1]
    assert [found[i]["start_word"] for i in ids] == [9 * k for k in range(len(ids))]
