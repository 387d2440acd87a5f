import glob
import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = ["filter_high_value", "intersect_all", "except_all", "as_of_join", "gae", "ess", "pivot_count", "describe", "diff_pct_shift", "vector_sort", "auc_roc", "text_bert", "event_summary"]


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else str([plain(x) for x in v]) if isinstance(v, list) else str(v)


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 100


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_sql(spark, name):
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    df = entry.queries()[name](spark, SF)
    found = c.execute(entry.oracle_sql()[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(plain(dict(zip(names, r, strict=True))[k]) for k in sorted(names)) for r in found.fetchall())
    assert sorted(tuple(plain(r[k]) for k in sorted(names)) for r in df.collect()) == want


@pytest.mark.parametrize("name", ["text_nfc_strip_accents_whole", "bpe_round_trip_whole", "byte_level_round_trip_whole", "token_positions_whole"])
def test_whole_table_agrees_with_sql(spark, name):
    test_query_agrees_with_sql(spark, name)
    if name != "token_positions_whole":
        assert entry.queries()[name](spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_linear_algebra_takes_all_vectors(spark):
    rows = {r["vec_id"]: r for r in entry.queries()["linear_algebra"](spark, SF).collect()}
    vectors = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()}
    assert set(rows) == set(vectors) and len(rows) > 50
    for i, e in vectors.items():
        m = e[:16].reshape(4, 4)
        assert rows[i]["det"] == pytest.approx(np.linalg.det(m), rel=1e-6, abs=1e-9) and rows[i]["rank"] == np.linalg.matrix_rank(m)
        assert np.allclose(m @ np.array(rows[i]["x"]), e[16:20], atol=1e-5)


WHOLE = ["matmul", "einsum_trace_of_product", "einsum_chain", "trace_diagonal", "outer_product", "tensor_reshape_roll", "matrix_norms", "image_box_blur", "image_morphology", "image_flip_crop", "join_inner", "join_left", "join_right", "join_outer"]


@pytest.mark.parametrize("name", WHOLE)
def test_whole_tensors_images_and_joins_agree_with_sql(spark, name):
    test_query_agrees_with_sql(spark, f"{name}_whole")
