"""From files to a stored memory: parse, embed, segment, consolidate, split, summarise, save."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnesis.functions.sets import tidy_entities
from mnesis.functions.text import mood
from mnesis.functions.times import time_label
from mnesis.functions.vectors import hashing_embedding, mean_vector, weighted_mean_vector
from mnesis.operators import graph, metrics, segment, summarise
from mnesis.shared import materialise
from mnesis.sources.readers import merge_sources, read_dataset
from mnesis.sources.writers import save_store
from mnesis.tables import micros

DIMENSION = 64


def prepare(artifacts: DataFrame, embed=hashing_embedding) -> DataFrame:
    """Segmenter input. ``embed`` maps a text column to a vector column; the default needs no model."""
    return artifacts.select(
        F.col("source").alias("stream"), "id", micros("timestamp").alias("us"), embed(F.col("content")).alias("vec"), tidy_entities(F.col("entities")).alias("entities"), F.lit(None).cast("double").alias("boundary"),
        "author", "content", "importance", "true_episode_id",
    )


def moving_centroids(m: DataFrame, ema: float) -> DataFrame:
    """``episode, moving``: the segmenter's centroid, the exponential moving average in time order, as a weighted mean."""
    w = Window.partitionBy("episode").orderBy(F.col("us").desc(), F.col("id").desc())
    x = m.where("vec is not null").withColumns({"_back": F.row_number().over(w) - 1, "_founder": F.lead("us").over(w).isNull()})
    weight = F.pow(F.lit(1 - ema), F.col("_back")) * F.when(F.col("_founder"), 1.0).otherwise(ema)
    return x.withColumn("_w", weight).groupBy("episode").agg(weighted_mean_vector("vec", "_w", DIMENSION).alias("moving"))


def arrange(rows: DataFrame, config: segment.SegmentConfig | None = None, split_span_hours: float = 48.0) -> tuple[DataFrame, DataFrame]:
    """Segmentation, consolidation and split: ``stream, id, episode_id`` and ``episode_id, status, memory``.

    Dormant are the episodes idle for longer than the dormancy when the newest artifact arrives. A
    consolidated episode keeps the name of its largest member and the sum of the memory scores;
    parts of a split one are named ``_S01`` and so on and share its score by their size. Members
    without a vector stay with the parent's name.
    """
    cfg = config or segment.SegmentConfig(hard_break_minutes=720)
    cut = segment.segment(rows.select("stream", "id", "us", "vec", "entities", "boundary"), cfg)
    raw = materialise(cut.select("stream", "id", F.concat_ws("-", "stream", F.col("session").cast("string"), F.col("episode_no").cast("string")).alias("episode")), "segmented")
    m = rows.join(raw, ["stream", "id"])
    founder = F.min_by("importance", F.struct("us", "id"))
    eps = m.groupBy("episode").agg(F.count(F.lit(1)).alias("n"), F.min("us").alias("start_us"), F.max("us").alias("end_us"), (1.0 + 0.1 * (F.sum("importance") - founder)).alias("memory"))
    eps = materialise(eps.join(moving_centroids(m, cfg.ema), "episode", "left").withColumnRenamed("moving", "centroid"), "raw-episodes")
    newest = rows.agg(F.max("us").alias("_now"))
    dormant = eps.crossJoin(F.broadcast(newest)).where(F.col("_now") - F.col("end_us") > int(cfg.dormancy_minutes * 60e6))
    group = materialise(segment.consolidate(eps, segment.consolidation_pairs(dormant, graph.edges(m, "episode", "entities"))), "consolidated")

    merged = eps.join(group, "episode", "left").withColumn("parent", F.coalesce("base", "episode"))
    parents = merged.groupBy("parent").agg(F.when(F.count("base") > 0, "consolidated").otherwise("raw").alias("status"), F.sum("memory").alias("memory"), F.sum("n").alias("n"))
    member = raw.join(group, "episode", "left").select("stream", "id", F.coalesce("base", "episode").alias("parent"))
    key = F.concat_ws("\n", "stream", "id")
    whole = rows.join(member, ["stream", "id"]).select(F.col("parent").alias("episode"), key.alias("id"), "us", "vec")
    large = whole.join(segment.split_candidates(whole, DIMENSION, span_hours=split_span_hours), "episode", "left_semi")
    parts = materialise(segment.split_large(large).where("part > 0").select(F.col("id").alias("key"), "part"), "parts")
    name = F.when(F.col("part").isNull(), F.col("parent")).otherwise(F.concat("parent", F.lit("_S"), F.lpad(F.col("part").cast("string"), 2, "0")))
    final = materialise(member.withColumn("key", key).join(parts, "key", "left").select("stream", "id", name.alias("episode_id"), "parent"), "membership")
    scores = final.groupBy("episode_id", "parent").agg(F.count(F.lit(1)).alias("k")).join(parents, "parent").select("episode_id", "status", (F.col("memory") * F.col("k") / F.col("n")).alias("memory"))
    return final.drop("parent"), materialise(scores, "scores")


def build(spark: SparkSession, paths: list[str], out: str | None = None, config: segment.SegmentConfig | None = None, embed=hashing_embedding) -> dict[str, DataFrame]:
    """Tables of a memory: artifacts, membership, episodes, entities of episodes, summaries."""
    rows = materialise(prepare(merge_sources([read_dataset(spark, p) for p in paths]), embed), "prepared")
    member, scores = arrange(rows, config)
    m = rows.join(member, ["stream", "id"])
    episodes = m.groupBy("episode_id").agg(
        F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count(F.lit(1)).alias("message_count"), mean_vector("vec", DIMENSION).alias("centroid"),
        F.array_sort(F.collect_set("author")).alias("participants"),
    )
    episodes = episodes.join(scores, "episode_id").withColumn("end_time", F.timestamp_micros("end_us"))
    edges = graph.edges(m, "episode_id", "entities")
    words = summarise.tfidf_keywords(m, "episode_id", "content", top=5).groupBy("episode_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("keywords"))
    named = edges.groupBy(F.col("episode").alias("episode_id")).agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "entity"))), lambda x: x["entity"]), 1, 4).alias("entities"))
    text = m.groupBy("episode_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("us", "id", "content"))), lambda x: x["content"]), " ").alias("text"))
    s = episodes.join(words, "episode_id", "left").join(named, "episode_id", "left").join(text, "episode_id", "left")
    empty = F.array().cast("array<string>")
    s = s.withColumns({"keywords": F.coalesce("keywords", empty), "entities": F.coalesce("entities", empty), "mood": mood(F.col("text")), "time": time_label(F.timestamp_micros("start_us").cast("timestamp_ntz"), F.timestamp_micros("end_us").cast("timestamp_ntz"))})
    summaries = s.select("episode_id", summarise.label(F.col("entities"), F.col("keywords"), F.col("text")).alias("label"), summarise.narrative(F.col("participants"), F.col("message_count"), F.col("time"), F.col("keywords"), F.col("mood")).alias("summary"), "keywords", "entities", "mood", "time")
    tables = {"artifacts": rows, "membership": member, "episodes": episodes, "links": edges, "summaries": summaries}
    if out:
        save_store(tables, out)
    return tables


def evaluate(tables: dict[str, DataFrame]) -> DataFrame:
    """Agreement with the labels that the artifacts carry."""
    m = tables["artifacts"].join(tables["membership"], ["stream", "id"])
    return metrics.agreement(m, "true_episode_id", "episode_id")


def grid_search(rows: DataFrame, thresholds=(0.25, 0.3, 0.35, 0.4), minutes=(60.0, 120.0, 240.0)) -> DataFrame:
    """Quality of each configuration, best first. The prepared rows are written once and read by every run."""
    spark = rows.sparkSession
    rows = materialise(rows, "grid-input")
    out = []
    for threshold, minute in product(thresholds, minutes):
        cfg = segment.SegmentConfig(threshold=threshold, time_minutes=minute, hard_break_minutes=720)
        member, _ = arrange(rows, cfg, split_span_hours=168.0)
        r = metrics.agreement(rows.join(member, ["stream", "id"]), "true_episode_id", "episode_id").collect()[0]  # one row
        out.append((threshold, minute, r.ari, r.nmi, r.n_pred, r.n_true))
    return spark.createDataFrame(out, "threshold double, time_minutes double, ari double, nmi double, n_episodes bigint, n_true bigint").orderBy(F.col("ari").desc_nulls_last(), "threshold", "time_minutes")
