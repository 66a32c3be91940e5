"""Multi-signal recall over an episode table and a small query table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnesis.functions.scores import half_life_recency, monthly_recency
from mnesis.functions.vectors import cosine
from mnesis.shared import materialise

BLOCK = 10_000


def recall(episodes: DataFrame, queries: DataFrame, k: int = 5, half_life: float = 168.0, least: float = 0.0, entity_score: Column | None = None) -> DataFrame:
    """``query_id, episode_id, relevance, rank``: the ``k`` best episodes of each query.

    ``episodes``: ``episode_id, centroid, hours_old, memory, status``; ``queries``: ``query_id,
    query_vec``. Up to ``BLOCK`` queries are broadcast at once; more are answered block by block, each
    block's ranks written to the shared folder before the next is broadcast. Similarity .50,
    entities .20, recency .15, memory .15. Archived episodes take no part. Ranks go by the score
    rounded to four places, then by id. Each task keeps only its own best ``k`` per query.
    """
    if queries.limit(BLOCK + 1).count() > BLOCK:
        kept = materialise(queries, "queries")
        blocks = -(-2 * kept.count() // BLOCK)  # half full on average, as ids are dealt by hash
        dealt = [kept.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i) for i in range(blocks)]
        return reduce(DataFrame.unionAll, [materialise(_recall(episodes, q, k, half_life, least, entity_score), "recalled") for q in dealt])
    return _recall(episodes, queries, k, half_life, least, entity_score)


def _recall(episodes: DataFrame, queries: DataFrame, k: int, half_life: float, least: float, entity_score: Column | None) -> DataFrame:
    top_memory = episodes.agg(F.max("memory").alias("_top"))
    scored = episodes.where("status <> 'archived'").crossJoin(F.broadcast(top_memory)).crossJoin(F.broadcast(queries))
    sem = F.greatest(F.coalesce(cosine("centroid", "query_vec"), F.lit(0.0)), F.lit(0.0))
    mem = F.when(F.col("_top") > 0, F.least(F.coalesce("memory", F.lit(0.0)) / F.col("_top"), F.lit(1.0))).otherwise(0.0)
    ent = entity_score if entity_score is not None else F.lit(0.0)
    score = F.round(0.5 * sem + 0.2 * ent + 0.15 * half_life_recency(F.coalesce("hours_old", F.lit(1e9)), half_life) + 0.15 * F.coalesce(mem, F.lit(0.0)), 4)
    ranked = scored.select("query_id", "episode_id", score.alias("relevance")).where(F.col("relevance") >= least)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("relevance").desc(), "episode_id"))
    return ranked.withColumn("rank", rank).where(F.col("rank") <= k)


def recall_by_time(episodes: DataFrame, start_us: int, end_us: int, k: int = 10) -> DataFrame:
    """Episodes overlapping a window: .7 coverage of the shorter span and .3 memory.

    ``episodes``: ``episode_id, start_us, end_us, memory``. Spans count as a second at least.
    """
    top = episodes.agg(F.max("memory").alias("_top"))
    inside = episodes.where((F.col("end_us") >= start_us) & (F.col("start_us") <= end_us)).crossJoin(F.broadcast(top))
    overlap = F.greatest((F.least("end_us", F.lit(end_us)) - F.greatest("start_us", F.lit(start_us))) / 1e6, F.lit(1.0))
    span = F.least(F.greatest((F.col("end_us") - F.col("start_us")) / 1e6, F.lit(1.0)), F.lit(max((end_us - start_us) / 1e6, 1.0)))
    score = F.round(0.7 * F.least(overlap / span, F.lit(1.0)) + 0.3 * F.coalesce(F.try_divide(F.col("memory"), F.col("_top")), F.lit(0.0)), 4)
    return inside.select("episode_id", "start_us", "end_us", score.alias("relevance")).orderBy(F.col("relevance").desc(), "episode_id").limit(k)


def store_search(episodes: DataFrame, query_vec: Column, k: int = 5) -> DataFrame:
    """Store search: .30 similarity, .25 recency, .25 salience, .15 resolution, .05 log of recalls."""
    score = (
        0.30 * F.coalesce(cosine("centroid", query_vec), F.lit(0.0)) + 0.25 * monthly_recency(F.coalesce("days_old", F.lit(1e6))) + 0.25 * F.coalesce("salience", F.lit(0.0))
        + 0.15 * F.coalesce("resolution", F.lit(0.0)) + 0.05 * F.log1p(F.coalesce("access_count", F.lit(0)))
    )
    return episodes.select("episode_id", F.round(score, 6).alias("score")).orderBy(F.col("score").desc(), "episode_id").limit(k)


def salience(episodes: DataFrame, k: int = 10) -> DataFrame:
    """Most salient episodes that are not archived: .6 memory and .4 recency."""
    score = 0.6 * F.col("memory") + 0.4 * half_life_recency(F.coalesce("hours_old", F.lit(1e9)))
    return episodes.where("status <> 'archived'").select("episode_id", F.round(score, 6).alias("score")).orderBy(F.col("score").desc(), "episode_id").limit(k)
