"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, levels, lm, merkle, neardup, packing, pii, quality, sharding, toxicity, turns, vectors, wrappers
from .common import remainder

Build = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def _scored(df: DataFrame, threshold: float) -> DataFrame:
    return df.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = _table(spark, folder, "documents"), _table(spark, folder, "labels")
    return _scored(toxicity.score(docs, toxicity.fit(docs, labels)), 0.3)


def op2_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, folder, "documents"))


def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = _table(spark, folder, "documents"), _table(spark, folder, "labels")
    return _scored(quality.score(docs, quality.fit(docs, labels), ["doc_id"]), 0.7)


def op4_language_scores(spark: SparkSession, folder: str) -> DataFrame:
    return lm.language_scores(_table(spark, folder, "documents"))


def op5_pii(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return pii.find(docs, pii.revealing_terms(docs), everywhere=True).drop("text", "clean")


def op6_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return wrappers.extract(_table(spark, folder, "pages"))


def op7_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.links(_table(spark, folder, "embeddings"))


def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(_table(spark, folder, "documents"))


def op9_near_copies(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_copies(_table(spark, folder, "documents")).select("doc_id", "class_id")


def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.contaminated(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op11_manifest(spark: SparkSession, folder: str) -> DataFrame:
    tampered = merkle.document_leaf(F.regexp_replace("text", "\n", ""))
    proofs = merkle.manifest(_table(spark, folder, "documents"), merkle.document_leaf(), F.when(remainder("doc_id", 2) == 0, tampered))
    return proofs.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("steps")), 256).alias("proof_sha256"), "folded_root", "verified")


def op12_level_packing(spark: SparkSession, folder: str) -> DataFrame:
    return levels.pack_levels(_table(spark, folder, "documents"))


def op13_turn_repair(spark: SparkSession, folder: str) -> DataFrame:
    return turns.summary(turns.repair(turns.damaged(_table(spark, folder, "conversations")), F.col("kept")))


QUERIES: dict[str, Build] = {f.__name__: f for f in (
    op1_toxicity, op2_sharding, op3_quality, op4_language_scores, op5_pii, op6_main_text, op7_near_vectors, op8_packing,
    op9_near_copies, op10_decontamination, op11_manifest, op12_level_packing, op13_turn_repair)}
SQL: dict[str, str] = {"op11_manifest": merkle.SQL, "op13_turn_repair": turns.SQL}
