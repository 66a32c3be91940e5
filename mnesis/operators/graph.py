"""Episode-entity graph queries. The edge table has one row per episode and entity with a weight."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnesis.functions.sets import tidy_entities


def edges(artifacts: DataFrame, episode: str, entities: str) -> DataFrame:
    """``episode, entity, weight``: artifacts of an episode that name the entity."""
    rows = artifacts.where(F.col(episode).isNotNull()).select(F.col(episode).alias("episode"), F.explode(tidy_entities(F.col(entities))).alias("entity"))
    return rows.groupBy("episode", "entity").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def entity_nodes(e: DataFrame) -> DataFrame:
    return e.groupBy("entity").agg(F.count(F.lit(1)).alias("n_episodes"), F.sum("weight").alias("total_weight"))


def bridge_entities(e: DataFrame, least: int = 2) -> DataFrame:
    return entity_nodes(e).where(F.col("n_episodes") >= least)


def related(e: DataFrame, queries: DataFrame, k: int = 3, least: float = 0.1) -> DataFrame:
    """``episode, other, similarity, rank``: the ``k`` most similar episodes of each query episode.

    Weighted Jaccard through shared entities. ``queries`` is a stated set of episodes, joined to the
    whole edge table on the entity: work grows with the edges of the query set's entities, never
    with all pairs of episodes.
    """
    totals = e.groupBy("episode").agg(F.sum("weight").alias("total"))
    q = e.join(queries.select("episode"), "episode", "left_semi").select(F.col("episode").alias("a"), "entity", F.col("weight").alias("wa"))
    shared = q.join(e.select(F.col("episode").alias("b"), "entity", F.col("weight").alias("wb")), "entity").where("a <> b")
    both = shared.groupBy("a", "b").agg(F.sum(F.col("wa") + F.col("wb")).alias("both"), F.count(F.lit(1)).alias("n_shared"))
    scored = both.join(totals.select(F.col("episode").alias("a"), F.col("total").alias("ta")), "a").join(totals.select(F.col("episode").alias("b"), F.col("total").alias("tb")), "b")
    scored = scored.withColumn("similarity", F.round(F.col("both") / (F.col("ta") + F.col("tb")), 6)).where(F.col("similarity") >= least)
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.col("similarity").desc(), "b"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("a").alias("episode"), F.col("b").alias("other"), "similarity", "n_shared", "rank")


def links_of(e: DataFrame, memory: DataFrame, queries: DataFrame, least_shared: int = 2) -> DataFrame:
    """``episode, n_links, best_score``: links of each query episode to episodes that share enough entities.

    The score of a link is the smaller memory score times the plain Jaccard of the entity sets.
    """
    sizes = e.groupBy("episode").agg(F.count(F.lit(1)).alias("size")).join(memory, "episode")
    q = e.join(queries.select("episode"), "episode", "left_semi").select(F.col("episode").alias("a"), "entity")
    n = q.join(e.select(F.col("episode").alias("b"), "entity"), "entity").where("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= least_shared)
    s = n.join(sizes.select(F.col("episode").alias("a"), F.col("size").alias("sa"), F.col("memory_score").alias("ma")), "a").join(sizes.select(F.col("episode").alias("b"), F.col("size").alias("sb"), F.col("memory_score").alias("mb")), "b")
    score = F.least("ma", "mb") * F.col("shared") / (F.col("sa") + F.col("sb") - F.col("shared"))
    return s.groupBy(F.col("a").alias("episode")).agg(F.count(F.lit(1)).alias("n_links"), F.round(F.max(score), 6).alias("best_score"))


def density(e: DataFrame) -> DataFrame:
    return e.agg(F.countDistinct("episode").alias("n_episodes"), F.countDistinct("entity").alias("n_entities"), F.count(F.lit(1)).alias("n_edges")).withColumn("density", F.try_divide(F.col("n_edges"), F.col("n_episodes") * F.col("n_entities")))


def to_dot(e: DataFrame, least_weight: float = 2, most_entities: int = 80, most_episodes: int = 50) -> str:
    """Graphviz text of the strongest entities and largest episodes (both numbers are bounds of the picture)."""
    entities = entity_nodes(e).where(F.col("total_weight") >= least_weight).orderBy(F.col("total_weight").desc(), "entity").limit(most_entities).select("entity")
    episodes = e.groupBy("episode").agg(F.sum("weight").alias("w")).orderBy(F.col("w").desc(), "episode").limit(most_episodes).select("episode")
    rows = e.join(F.broadcast(entities), "entity").join(F.broadcast(episodes), "episode").orderBy("episode", "entity").collect()  # at most 4,000 rows
    quote = lambda s: '"' + str(s).replace('"', "'") + '"'
    lines = [f"  {quote(r.episode)} -- {quote(r.entity)} [penwidth={min(max(r.weight / 2, 0.5), 5):g}];" for r in rows]
    return "graph memory {\n" + "\n".join(lines) + "\n}\n"
