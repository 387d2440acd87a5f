import corpus_pipeline as P
from brindle.llm import packing, toxicity

from .helpers import classes, shingles

SF = "/root/testdata/sf0.001"


def test_pipeline_agrees_with_its_rules(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(frame, spark.read.parquet(f"{SF}/labels.parquet"))
    left = {i: t for i, t in docs.items() if model.score(t) < 0.3}
    sets = {i: shingles(t) for i, t in left.items()}
    linked = lambda a, b: bool(sets[a]) and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    left = {i: left[i] for i, c in classes(sorted(left), linked).items() if i == c}
    items = [shingles(r["text"].lower()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = {i: t for i, t in left.items() if not any(100 * len(s & shingles(t.lower())) >= 75 * len(s) for s in items)}
    got = P.run(spark, SF).collect()
    assert {r["doc_id"] for r in got} == set(left) and 0 < len(left) < len(docs)
    bins = {}
    for r in got:
        bins[r["bin_id"]] = bins.get(r["bin_id"], 0) + r["n_tokens"]
    assert max(bins.values()) <= 2048
    assert [n for n, _ in P.STAGES] == ["toxicity", "minhash_near_dedup", "benchmark_decontamination", "pii", "best_fit_packing"]


def test_stages_take_odd_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.limit(20).selectExpr("doc_id", "if(doc_id % 3 = 0, null, text) as text", "cast(null as string) lang", "if(doc_id % 2 = 0, null, source) as source", "n_chars")
    for frame in (docs.limit(0), odd.union(odd.limit(5))):
        for name, stage in P.STAGES[:-1]:
            out = stage(spark, frame, SF)
            assert out.columns == frame.columns and out.count() <= frame.count(), name
        assert packing.pack(frame).count() >= frame.count() - 5 if frame.count() else True


def test_registered():
    import __spark_entry__ as e

    names = [n for n in e.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in e.queries()
