"""Sinks: stores, upserts, partial updates and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def save_store(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def upsert_latest(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of both by key, the latest of each; an aggregate that combines before the shuffle."""
    both = old.unionByName(new, allowMissingColumns=True)
    rest = [c for c in both.columns if c != key]
    last = both.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(F.col(order), *[F.col(c) for c in rest if not dict(both.dtypes)[c].startswith("map")])).alias("r"))
    return last.select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def enrich(episodes: DataFrame, updates: DataFrame, model: str, now_us: int) -> DataFrame:
    """Partial update: fields of ``updates`` that are not null replace the old; the status becomes enriched."""
    fields = [c for c in updates.columns if c != "episode_id"]
    u = updates.select("episode_id", *[F.col(c).alias(f"_{c}") for c in fields], F.lit(True).alias("_hit"))
    x = episodes.join(u, "episode_id", "left")
    for c in fields:
        x = x.withColumn(c, F.coalesce(F.col(f"_{c}"), F.col(c))) if c in episodes.columns else x.withColumn(c, F.col(f"_{c}"))
    when = lambda value, name: F.when(F.col("_hit"), value).otherwise(F.col(name) if name in episodes.columns else F.lit(None))
    x = x.withColumns({"status": when(F.lit("enriched"), "status"), "summary_model": when(F.lit(model), "summary_model"), "summary_updated_us": when(F.lit(now_us), "summary_updated_us")})
    return x.drop("_hit", *[f"_{c}" for c in fields])


def mark_failed(episodes: DataFrame, ids: DataFrame) -> DataFrame:
    hit = ids.select("episode_id", F.lit(True).alias("_hit")).distinct()
    return episodes.join(hit, "episode_id", "left").withColumn("status", F.when(F.col("_hit"), "failed_enrichment").otherwise(F.col("status"))).drop("_hit")


def touch(episodes: DataFrame, returned: DataFrame, now_us: int) -> DataFrame:
    """Side effect of a search as a job of its own: counts a recall of every returned episode; the others keep their values."""
    hit = returned.select("episode_id", F.lit(1).alias("_hit")).distinct()
    x = episodes.join(hit, "episode_id", "left")
    return x.withColumn("access_count", F.coalesce("access_count", F.lit(0)) + F.coalesce("_hit", F.lit(0))).withColumn("last_accessed_us", F.when(F.col("_hit") == 1, F.lit(now_us)).otherwise(F.col("last_accessed_us") if "last_accessed_us" in episodes.columns else F.lit(None))).drop("_hit")


def save_csv(artifacts: DataFrame, path: str) -> None:
    out = artifacts.withColumn("entities", F.array_join("entities", ",")).withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm")).withColumnRenamed("id", "artifact_id")
    out.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def bulk_load(members: DataFrame, dimension: int) -> DataFrame:
    """Store rows of segmented messages: ``episode, us, channel, author, vec`` to one pending row per episode."""
    from mnesis.functions.vectors import mean_vector

    return members.groupBy(F.col("episode").alias("episode_id")).agg(
        F.lit("pending_enrichment").alias("status"), F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count(F.lit(1)).alias("message_count"),
        F.array_sort(F.collect_set("channel")).alias("channels"), F.array_sort(F.collect_set("author")).alias("participants"), mean_vector("vec", dimension).alias("centroid"),
    )
