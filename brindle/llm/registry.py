"""The registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, embeddings, html, packing, pii, secrets, sql, substring, toxicity, warc
from .neardup import near_duplicates


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_weak_supervision_pii(spark: SparkSession, d: str) -> DataFrame:
    return pii.digest(pii.find_pii(_read(spark, d, "documents")))


def op2_minhash_decontamination(spark: SparkSession, d: str) -> DataFrame:
    return decontam.find_contamination(_read(spark, d, "documents"), _read(spark, d, "benchmark"))


def op3_page_differencing(spark: SparkSession, d: str) -> DataFrame:
    return html.extract(_read(spark, d, "pages"))


def op4_arc_to_warc(spark: SparkSession, d: str) -> DataFrame:
    return warc.round_trip(_read(spark, d, "pages"))


def op5_int8_embedding_dedup(spark: SparkSession, d: str) -> DataFrame:
    return embeddings.near_duplicates(_read(spark, d, "embeddings"))


def op6_lexicon_toxicity(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.scored(_read(spark, d, "documents"), _read(spark, d, "labels"))


def _pack_apart(docs: DataFrame) -> DataFrame:
    """Packed so that near copies share no bin: their clusters are the components of op9."""
    near = near_duplicates(docs).where("doc_id is not null").select("doc_id", "component_id").distinct()
    return packing.pack(docs, clusters=near)


def op7_best_fit_packing(spark: SparkSession, d: str) -> DataFrame:
    return _pack_apart(_read(spark, d, "documents"))


def op8_trigram_secrets(spark: SparkSession, d: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(_read(spark, d, "documents")))


def op9_minhash_near_dedup(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates(_read(spark, d, "documents"))


def op10_compact_window_passages(spark: SparkSession, d: str) -> DataFrame:
    return substring.repeated_passages(_read(spark, d, "documents"))


QUERIES = {
    "op1_weak_supervision_pii": op1_weak_supervision_pii,
    "op2_minhash_decontamination": op2_minhash_decontamination,
    "op3_page_differencing": op3_page_differencing,
    "op4_arc_to_warc": op4_arc_to_warc,
    "op5_int8_embedding_dedup": op5_int8_embedding_dedup,
    "op6_lexicon_toxicity": op6_lexicon_toxicity,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_trigram_secrets": op8_trigram_secrets,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_compact_window_passages": op10_compact_window_passages,
}
ORACLES = {
    "op2_minhash_decontamination": sql.OP2,
    "op4_arc_to_warc": sql.OP4,
    "op5_int8_embedding_dedup": sql.OP5,
    "op8_trigram_secrets": sql.OP8,
    "op9_minhash_near_dedup": sql.OP9,
}
