"""Entities of artifacts: injection of mentions, removal of participants, mention sources; graph increments and candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnesis.functions.sets import tidy_entities
from mnesis.functions.text import normalise_form
from mnesis.functions.vectors import cosine
from mnesis.shared import parallelism

# Types that may stand for one another.
ABSTRACT_TYPES = ["PROJECT", "EVENT", "PRODUCT", "DATE_EVENT", "DOCUMENT", "CONCEPT"]
PERSON_TYPES = ["PERSON", "EMAIL", "HANDLE"]


def compatible_types(a: Column, b: Column) -> Column:
    """Equal types; UNKNOWN with any; abstract ones together; persons, addresses and handles together. A null is UNKNOWN."""
    a, b = F.coalesce(a, F.lit("UNKNOWN")), F.coalesce(b, F.lit("UNKNOWN"))
    return (a == b) | (a == "UNKNOWN") | (b == "UNKNOWN") | (a.isin(ABSTRACT_TYPES) & b.isin(ABSTRACT_TYPES)) | (a.isin(PERSON_TYPES) & b.isin(PERSON_TYPES))


def without_participants(artifacts: DataFrame, author: str, entities: str) -> DataFrame:
    """Adds ``kept`` and ``removed``: entities that name no author of any artifact, and those that do.

    Case and surrounding spaces are ignored. Distinct entity names meet distinct authors in a join, so
    neither list is ever held in one place; a null list of entities stays null.
    """
    tidy = lambda c: F.lower(F.trim(c))
    authors = artifacts.where(F.col(author).isNotNull()).select(tidy(F.col(author)).alias("_name")).distinct()
    numbered = artifacts.withColumn("_row", F.xxhash64(*[c for c in artifacts.columns]))
    named = numbered.select("_row", F.explode(tidy_entities(F.col(entities))).alias("_name")).distinct()
    hits = named.join(authors, "_name").groupBy("_row").agg(F.collect_set("_name").alias("_hits"))
    x = numbered.join(hits, "_row", "left")
    hit = lambda e: F.array_contains(F.coalesce("_hits", F.array().cast("array<string>")), tidy(e))
    return x.withColumns({"kept": F.filter(entities, lambda e: ~hit(e)), "removed": F.filter(entities, hit)}).drop("_row", "_hits")


def injected_entities(mentions: DataFrame, canonical: DataFrame) -> DataFrame:
    """``artifact_id, names``: canonical names of the mentions of each artifact, each once, in the order of the mentions.

    A mention means the entity one of whose names it equals after normalisation and whose type is
    compatible; among several the smallest id.
    """
    names = canonical.where("entity_id is not null").select(
        "entity_id", "canonical_name", F.col("entity_type").alias("_type"),
        F.explode(F.array_distinct(F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("_alias"),
    ).where("_alias is not null and canonical_name is not null")
    names = names.select("entity_id", "canonical_name", "_type", normalise_form(F.col("_alias")).alias("_form")).where("_form <> ''").distinct()
    forms = mentions.where("source_artifact_id is not null and surface_form is not null").select("mention_id", F.col("source_artifact_id").alias("artifact_id"), "entity_type", normalise_form(F.col("surface_form")).alias("_form"))
    hit = forms.join(names, "_form").where(compatible_types(F.col("entity_type"), F.col("_type")))
    hit = hit.groupBy("mention_id", "artifact_id").agg(F.min(F.struct("entity_id", "canonical_name")).alias("e"))
    first = hit.groupBy("artifact_id", F.col("e.canonical_name").alias("name")).agg(F.min("mention_id").alias("at"))
    return first.groupBy("artifact_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]).alias("names"))


def model_entities(mentions: DataFrame, methods: list[str]) -> DataFrame:
    """``artifact_id, n_entities, n_types``: distinct forms that a model (not a pattern or a header) found in an artifact."""
    m = mentions.where(F.col("extraction_method").isin(methods) & F.col("source_artifact_id").isNotNull() & F.col("surface_form").isNotNull())
    form = normalise_form(F.col("surface_form"))
    return m.where(form != "").groupBy(F.col("source_artifact_id").alias("artifact_id")).agg(F.countDistinct(form).alias("n_entities"), F.countDistinct("entity_type").alias("n_types"))


def metadata_mentions(artifacts: DataFrame) -> DataFrame:
    """``artifact_id, surface_form, entity_type, confidence``: the author of each artifact and its listed entities."""
    author = artifacts.where("author is not null and lower(trim(author)) not in ('', 'unknown', 'système', 'system')").select("artifact_id", F.col("author").alias("surface_form"), F.lit("PERSON").alias("entity_type"), F.lit(0.95).alias("confidence"))
    listed = artifacts.select("artifact_id", F.explode("entities").alias("surface_form")).where("trim(surface_form) <> ''")
    return author.unionByName(listed.select("artifact_id", "surface_form", F.lit("CONCEPT").alias("entity_type"), F.lit(0.70).alias("confidence")))


def add_edges(edges: DataFrame, more: DataFrame) -> DataFrame:
    """Edge table with further artifacts' edges: weights of equal episode and entity add up."""
    return edges.unionByName(more).groupBy("episode", "entity").agg(F.sum("weight").alias("weight"))


def _spread_join(small: DataFrame, large: DataFrame, key: str, by: str) -> DataFrame:
    """Join of keys that may be few and hot: ``large`` is dealt by ``by`` into parts of each key, ``small`` goes to the parts that occur."""
    n = parallelism(large.sparkSession)
    large = large.withColumn("_part", F.pmod(F.xxhash64(by), F.lit(n)))
    copies = small.join(large.select(key, "_part").distinct(), key)
    return copies.join(large.repartition(n, key, "_part"), [key, "_part"]).drop("_part")


def shared_by_several(edges: DataFrame, artifacts: DataFrame, ratio: float = 0.7) -> DataFrame:
    """``artifact_id, episode, score``: artifacts that belong to two episodes or more about as well as to the best.

    ``edges``: ``episode, entity, weight``; ``artifacts``: ``artifact_id, entities``. The score is the weight of
    the shared entities over the size of both sets together times the episode's largest weight. It is the same for
    all artifacts of one set of entities: each different set meets the edges once, named by its smallest artifact.
    """
    own = artifacts.select("artifact_id", F.array_sort(tidy_entities(F.col("entities"))).alias("_own")).where(F.size("_own") > 0)
    sets = own.groupBy("_own").agg(F.min("artifact_id").alias("_set"))
    e = Window.partitionBy("episode")
    sized = edges.withColumns({"n_e": F.count(F.lit(1)).over(e), "top": F.max("weight").over(e)})
    both = _spread_join(sets.select("_set", F.size("_own").alias("n_a"), F.explode("_own").alias("entity")), sized, "entity", "episode").repartition(parallelism(edges.sparkSession), "_set")
    both = both.groupBy("_set", "n_a", "episode", "n_e", "top").agg(F.sum("weight").alias("w"), F.count(F.lit(1)).alias("shared"))
    both = both.select("_set", "episode", (F.col("w") / ((F.col("n_a") + F.col("n_e") - F.col("shared")) * F.col("top"))).alias("score"))
    w = Window.partitionBy("_set")
    near = both.withColumn("_best", F.max("score").over(w)).where(F.col("score") >= ratio * F.col("_best") - 1e-12)
    near = near.withColumn("_n", F.count(F.lit(1)).over(w)).where("_n >= 2").select("_set", "episode", F.round("score", 6).alias("score"))
    return _spread_join(near.join(sets, "_set").drop("_set"), own, "_own", "artifact_id").select("artifact_id", "episode", "score")


def index_candidates(episodes: DataFrame, edges: DataFrame, query_vec: Column, entities: list[str], k: int = 20) -> DataFrame:
    """``episode``: the ``k`` most similar episodes together with all that hold one of the query's entities, each once."""
    similar = episodes.where("centroid is not null").select("episode", cosine("centroid", query_vec).alias("_s")).orderBy(F.col("_s").desc(), "episode").limit(k)
    return similar.select("episode").union(edges.where(F.col("entity").isin(entities)).select("episode")).distinct()


def prepared_text(content: Column, entities: Column, most: int = 256) -> Column:
    """Text for a classifier: content with up to four entities in brackets, cut at ``most`` characters; a dot when empty."""
    named = F.array_join(F.slice(F.coalesce(entities, F.array().cast("array<string>")), 1, 4), ", ")
    whole = F.concat(F.coalesce(content, F.lit("")), F.when(named != "", F.concat(F.lit(" ["), named, F.lit("]"))).otherwise(""))
    cut = F.substring(whole, 1, most)
    return F.when(F.trim(cut) == "", ".").otherwise(cut)


def fused(df: DataFrame, score: str, against: str) -> DataFrame:
    """Adds ``fused``: one score times what another leaves, both stretched to 0..1 over the table (0 where it is constant)."""
    bounds = df.agg(F.min(score).alias("_a"), F.max(score).alias("_b"), F.min(against).alias("_c"), F.max(against).alias("_d"))
    x = df.crossJoin(F.broadcast(bounds))  # one row
    scaled = lambda c, lo, hi: F.coalesce(F.try_divide(F.col(c) - F.col(lo), F.col(hi) - F.col(lo)), F.lit(0.0))
    return x.withColumn("fused", scaled(score, "_a", "_b") * (1 - scaled(against, "_c", "_d"))).drop("_a", "_b", "_c", "_d")


def boundary_statistics(df: DataFrame, probability: str, least: float = 0.5) -> DataFrame:
    """One row: rate of boundaries, and mean, quartiles of their probabilities. All but the counts are null without any."""
    at = F.when(F.col(probability) >= least, F.col(probability))
    return df.agg(
        F.count(F.lit(1)).alias("n"), F.count(at).alias("n_boundaries"), F.try_divide(F.count(at), F.count(F.lit(1))).alias("rate"), F.avg(at).alias("mean_p"),
        F.percentile(at, F.lit(0.25)).alias("p25"), F.percentile(at, F.lit(0.75)).alias("p75"),
    )


def archive_old(episodes: DataFrame, days: int = 90) -> DataFrame:
    """Consolidated episodes become archived after ``days`` whole days; archived ones give up their members (``message_count`` 0)."""
    old = (F.col("state") == "CONSOLIDATED") & (F.floor("days_old") >= days)
    x = episodes.withColumn("state", F.when(old, "ARCHIVED").otherwise(F.col("state")))
    return x.withColumn("message_count", F.when(F.col("state") == "ARCHIVED", 0).otherwise(F.col("message_count")))
