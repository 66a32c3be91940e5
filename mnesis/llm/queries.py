"""Registered queries of the training-data operators on text, names and vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnesis.llm import language, leaks, names, neighbours, packing, privacy, runs
from mnesis.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return runs.collapse_runs(table(spark, d, "artifacts")).select("first_id", "last_id")


def p1_runs(spark: SparkSession, d: str) -> DataFrame:
    return runs.collapse_runs(table(spark, d, "artifacts"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return names.link_mentions(table(spark, d, "mentions"), table(spark, d, "canonical_entities")).select("mention_id", "entity_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    m = neighbours.neighbour_pairs(table(spark, d, "message_embeddings"), "message_id", "embedding")
    e = neighbours.neighbour_pairs(table(spark, d, "episodes"), "episode_id", "centroid_emb")
    return m.select(F.lit("message_embeddings").alias("tab"), "id_lo", "id_hi").unionByName(e.select(F.lit("episodes").alias("tab"), "id_lo", "id_hi"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    texts = privacy.texts_of(table(spark, d, "messages"), table(spark, d, "artifacts"))
    return privacy.find_personal(texts, table(spark, d, "canonical_entities"))


def p5_sanitised(spark: SparkSession, d: str) -> DataFrame:
    texts = privacy.texts_of(table(spark, d, "messages"), table(spark, d, "artifacts"))
    return privacy.sanitise(texts, privacy.find_personal(texts, table(spark, d, "canonical_entities")))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return language.relabel(table(spark, d, "documents")).select("doc_id", "seg_no", "lang")


def p10_segments(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return language.identify(documents, language.fit_on(documents))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_runs, p3_found, p4_found, p5_found, p5_sanitised, p8_containers, p9_found, p10_found, p10_segments)}


def oracle_sql() -> dict[str, str]:
    """SQL cannot express these operators; ``tests/llm`` holds them against brute force and round trips."""
    return {}
