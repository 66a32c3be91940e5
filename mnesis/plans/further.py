"""Registered queries of entity enrichment, graph increments, statistics and upkeep, each with the SQL that must agree."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnesis.functions import text, vectors
from mnesis.operators import enrich, features, graph
from mnesis.plans import catalogue as c
from mnesis.sources.writers import touch
from mnesis.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


_FORM = r"trim(regexp_replace(regexp_replace(lower(trim({0})), '[^\p{{L}}\p{{M}}\p{{N}}_@.\-\s]', '', 'g'), '\s+', ' ', 'g'))"
_PERSONS, _ABSTRACT = "('PERSON', 'EMAIL', 'HANDLE')", "('PROJECT', 'EVENT', 'PRODUCT', 'DATE_EVENT', 'DOCUMENT', 'CONCEPT')"
_COMPATIBLE = f"(coalesce({{0}}, 'UNKNOWN') = coalesce({{1}}, 'UNKNOWN') OR coalesce({{0}}, 'UNKNOWN') = 'UNKNOWN' OR coalesce({{1}}, 'UNKNOWN') = 'UNKNOWN' OR ({{0}} IN {_ABSTRACT} AND {{1}} IN {_ABSTRACT}) OR ({{0}} IN {_PERSONS} AND {{1}} IN {_PERSONS}))"


@query(
    f"""WITH n AS (SELECT DISTINCT entity_id, canonical_name, entity_type, {_FORM.format('a')} AS form FROM (SELECT *, unnest(list_prepend(canonical_name, coalesce(aliases, []))) AS a FROM canonical_entities WHERE entity_id IS NOT NULL AND canonical_name IS NOT NULL) WHERE a IS NOT NULL),
m AS (SELECT mention_id, source_artifact_id, entity_type, {_FORM.format('surface_form')} AS form FROM mentions WHERE source_artifact_id IS NOT NULL AND surface_form IS NOT NULL),
h AS (SELECT mention_id, source_artifact_id, arg_min(canonical_name, entity_id) AS name FROM m JOIN n USING (form) WHERE form <> '' AND {_COMPATIBLE.format('m.entity_type', 'n.entity_type')} GROUP BY ALL),
f AS (SELECT source_artifact_id, name, min(mention_id) AS pos FROM h GROUP BY ALL)
SELECT source_artifact_id AS artifact_id, string_agg(name, '|' ORDER BY pos) AS names FROM f GROUP BY ALL"""
)
def injected_entities(spark, d):
    x = enrich.injected_entities(table(spark, d, "mentions"), table(spark, d, "canonical_entities"))
    return x.select("artifact_id", F.array_join("names", "|").alias("names"))


@query(
    f"""WITH {c._ARTS}, au AS (SELECT DISTINCT lower(trim(author)) AS name FROM arts WHERE author IS NOT NULL), e AS (SELECT artifact_id, unnest(entities) AS x FROM arts)
SELECT artifact_id, count(*) FILTER (WHERE lower(trim(x)) NOT IN (SELECT name FROM au)) AS n_kept, count(*) FILTER (WHERE lower(trim(x)) IN (SELECT name FROM au)) AS n_removed FROM e WHERE x IS NOT NULL GROUP BY ALL"""
)
def participants_removed(spark, d):
    x = enrich.without_participants(c.artifacts(spark, d).select("artifact_id", "author", F.filter("entities", lambda e: e.isNotNull()).alias("entities")), "author", "entities")
    return x.where(F.size("entities") > 0).select("artifact_id", F.size("kept").cast("bigint").alias("n_kept"), F.size("removed").cast("bigint").alias("n_removed"))


@query(
    f"""SELECT source_artifact_id AS artifact_id, count(DISTINCT form) AS n_entities, count(DISTINCT entity_type) AS n_types FROM (SELECT *, {_FORM.format('surface_form')} AS form FROM mentions
WHERE extraction_method IN ('gliner', 'spacy') AND source_artifact_id IS NOT NULL AND surface_form IS NOT NULL) WHERE form <> '' GROUP BY ALL"""
)
def enriched_artifacts(spark, d):
    return enrich.model_entities(table(spark, d, "mentions"), ["gliner", "spacy"])


@query(
    f"""WITH {c._ARTS}, m AS (SELECT author AS form, 'PERSON' AS entity_type FROM arts WHERE author IS NOT NULL AND lower(trim(author)) NOT IN ('', 'unknown', 'système', 'system')
UNION ALL SELECT form, 'CONCEPT' FROM (SELECT unnest(entities) AS form FROM arts) WHERE trim(form) <> '') SELECT form AS surface_form, entity_type, count(*) AS n, round(max(CASE entity_type WHEN 'PERSON' THEN 0.95 ELSE 0.7 END), 2)::DOUBLE AS confidence FROM m GROUP BY ALL"""
)
def metadata_mentions(spark, d):
    m = enrich.metadata_mentions(c.artifacts(spark, d))
    return m.groupBy("surface_form", "entity_type").agg(F.count(F.lit(1)).alias("n"), F.max("confidence").alias("confidence"))


@query(f"SELECT a.entity_type AS left_type, b.entity_type AS right_type, {_COMPATIBLE.format('a.entity_type', 'b.entity_type')} AS compatible FROM (SELECT DISTINCT entity_type FROM mentions) a, (SELECT DISTINCT entity_type FROM mentions) b")
def compatible_types(spark, d):
    t = table(spark, d, "mentions").select("entity_type").distinct()
    x = t.select(F.col("entity_type").alias("left_type")).crossJoin(F.broadcast(t.select(F.col("entity_type").alias("right_type"))))  # a few types
    return x.withColumn("compatible", enrich.compatible_types(F.col("left_type"), F.col("right_type")))


@query(f"WITH {c._EDGES} SELECT episode, entity, weight FROM edges")
def incremental_edges(spark, d):
    """The edge table built from two halves of the artifacts, the second added to the first; equal to the whole."""
    a = c.artifacts(spark, d)
    half = F.pmod(F.xxhash64("artifact_id"), F.lit(2))
    return enrich.add_edges(*[graph.edges(a.where(half == i), "episode", "entities") for i in (0, 1)])


@query(
    f"""WITH {c._EDGES}, sz AS (SELECT episode, count(*) AS n_e, max(weight) AS top FROM edges GROUP BY episode),
own AS (SELECT artifact_id, list_distinct(list_filter(list_transform(entities, lambda x: lower(trim(x))), lambda x: x IS NOT NULL AND x <> '')) AS e FROM arts),
o AS (SELECT artifact_id, len(e) AS n_a, unnest(e) AS entity FROM own),
b AS (SELECT artifact_id, episode, sum(weight) / ((any_value(n_a) + any_value(n_e) - count(*)) * any_value(top)) AS score FROM o JOIN edges USING (entity) JOIN sz USING (episode) GROUP BY ALL),
r AS (SELECT * FROM (SELECT *, max(score) OVER (PARTITION BY artifact_id) AS best FROM b) WHERE score >= 0.7 * best - 1e-12), n AS (SELECT *, count(*) OVER (PARTITION BY artifact_id) AS k FROM r)
SELECT artifact_id, episode, round(score, 6) AS score FROM n WHERE k >= 2"""
)
def multi_episode_artifacts(spark, d):
    return enrich.shared_by_several(c._edges(spark, d), c.artifacts(spark, d).select("artifact_id", "entities"))


@query(
    f"""WITH {c._STORE}, q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0), s AS (SELECT episode_id AS episode, list_cosine_similarity(centroid, v) AS s FROM store, q WHERE centroid IS NOT NULL ORDER BY s DESC, episode LIMIT 20)
SELECT episode FROM s UNION SELECT episode_id FROM (SELECT episode_id, unnest(participants) AS p FROM episodes) WHERE p IN ('u-00000000', 'u-00000001')"""
)
def index_candidates(spark, d):
    e = c.store(spark, d).crossJoin(F.broadcast(table(spark, d, "embeddings").where("vec_id = 0").select(F.col("embedding").alias("query_vec"))))  # one row
    edges = table(spark, d, "episodes").select(F.col("episode_id").alias("episode"), F.explode("participants").alias("entity"))
    return enrich.index_candidates(e.withColumnRenamed("episode_id", "episode"), edges, F.col("query_vec"), ["u-00000000", "u-00000001"])


@query(
    f"""WITH {c._STORE}, q AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT vec_id AS query_id, episode_id, list_cosine_similarity(centroid, v) AS sim FROM store, q WHERE status NOT IN ('archived') AND centroid IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, episode_id) AS n FROM s WHERE sim > 0)
SELECT query_id, episode_id, round(sim, 6) AS similarity FROM r WHERE n = 1"""
)
def best_active_episode(spark, d):
    q = table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    x = q.crossJoin(c.store(spark, d).where("status <> 'archived' and centroid is not null").select("episode_id", "centroid"))
    sim = vectors.cosine("centroid", "query_vec")
    best = x.select("query_id", "episode_id", sim.alias("s")).where("s > 0").groupBy("query_id").agg(F.min(F.struct((-F.round("s", 9)).alias("n"), "episode_id", "s")).alias("b"))
    return best.select("query_id", "b.episode_id", F.round("b.s", 6).alias("similarity"))


@query(
    f"""WITH {c._ARTS}, p AS (SELECT artifact_id, coalesce(content, '') || CASE WHEN len(list_filter(entities[1:4], lambda x: x IS NOT NULL)) > 0 AND array_to_string(list_filter(entities[1:4], lambda x: x IS NOT NULL), ', ') <> '' THEN ' [' || array_to_string(list_filter(entities[1:4], lambda x: x IS NOT NULL), ', ') || ']' ELSE '' END AS t FROM arts)
SELECT artifact_id, CASE WHEN trim(substring(t, 1, 256)) = '' THEN '.' ELSE substring(t, 1, 256) END AS prepared FROM p"""
)
def prepared_texts(spark, d):
    return c.artifacts(spark, d).select("artifact_id", enrich.prepared_text(F.col("content"), F.col("entities")).alias("prepared"))


_GOALS = " || ".join(f"CASE WHEN regexp_matches(coalesce(content, ''), {c._quote('(?i)(?:^|[^\\p{L}\\p{N}_])(?:' + w + ')(?:$|[^\\p{L}\\p{N}_])')}) THEN {c._quote('|' + p)} ELSE '' END" for w, p in text.GOAL_WORDS.items())
_TYPES = "CASE artifact_type " + " ".join(f"WHEN {c._quote(k)} THEN {c._quote(v)}" for k, v in text.GOAL_TYPES.items()) + " ELSE 'general activity' END"


@query(
    f"""WITH {c._ARTS} SELECT artifact_id, {_TYPES} || {_GOALS} || CASE WHEN len(entities) > 0 THEN '|related to ' || array_to_string(list_filter(entities[1:4], lambda x: x IS NOT NULL), ', ') ELSE '' END AS phrases FROM arts"""
)
def goal_phrases(spark, d):
    return c.artifacts(spark, d).select("artifact_id", F.array_join(text.goal_phrases(F.col("content"), F.col("artifact_type"), F.col("entities")), "|").alias("phrases"))


_GAPS = "g AS (SELECT event_id, value, least(coalesce(ln(1 + (us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id)) / 6e7) / ln(1441), 1.0), 1.0) AS p FROM ev)"


def _gaps(spark, d):
    return features.previous_gap(c.events(spark, d), "user_id", "us", "event_id").select("event_id", "value", F.least("gap_log", F.lit(1.0)).alias("p"))


@query(f"WITH {c._EVENTS}, {_GAPS} SELECT count(*) AS n, count(*) FILTER (WHERE p >= 0.5) AS n_boundaries, round((count(*) FILTER (WHERE p >= 0.5))::DOUBLE / count(*), 6) AS rate, round(avg(p) FILTER (WHERE p >= 0.5), 6) AS mean_p, round(quantile_cont(p, 0.25) FILTER (WHERE p >= 0.5), 6) AS p25, round(quantile_cont(p, 0.75) FILTER (WHERE p >= 0.5), 6) AS p75 FROM g")
def boundary_statistics(spark, d):
    s = enrich.boundary_statistics(_gaps(spark, d), "p")
    return s.select("n", "n_boundaries", *[F.round(x, 6).alias(x) for x in ("rate", "mean_p", "p25", "p75")])


@query(f"WITH {c._EVENTS}, {_GAPS} SELECT event_id, round(p, 6) AS p FROM g WHERE p > 0.2 AND p < 0.8")
def ambiguity_zone(spark, d):
    return _gaps(spark, d).where("p > 0.2 and p < 0.8").select("event_id", F.round("p", 6).alias("p"))


@query(f"WITH {c._EVENTS}, {_GAPS}, b AS (SELECT min(p) AS a, max(p) AS b, min(value) AS c, max(value) AS d FROM g) SELECT event_id, round(coalesce((p - a) / nullif(b - a, 0), 0) * (1 - coalesce((value - c) / nullif(d - c, 0), 0)), 6) AS fused FROM g, b")
def fused_scores(spark, d):
    return enrich.fused(_gaps(spark, d), "p", "value").select("event_id", F.round("fused", 6).alias("fused"))


@query(
    f"""WITH {c._STATES} SELECT episode_id, CASE WHEN state = 'CONSOLIDATED' AND floor(st.days_old) >= 90 THEN 'ARCHIVED' ELSE state END AS state,
CASE WHEN state = 'ARCHIVED' OR (state = 'CONSOLIDATED' AND floor(st.days_old) >= 90) THEN 0 ELSE message_count END AS message_count FROM st JOIN episodes USING (episode_id)"""
)
def archived_old(spark, d):
    return enrich.archive_old(c._states(spark, d)).select("episode_id", "state", "message_count")


@query(
    f"""WITH {c._STORE}, hit AS (SELECT episode_id FROM store WHERE status <> 'archived' ORDER BY round(0.6 * memory + 0.4 * power(2.0, -greatest(coalesce(hours_old, 1e9), 0.0) / 168.0), 6) DESC, episode_id LIMIT 10)
SELECT episode_id, (coalesce(access_count, 0) + (episode_id IN (SELECT episode_id FROM hit))::INT)::INT AS access_count, CASE WHEN episode_id IN (SELECT episode_id FROM hit) THEN {c.NOW_US} ELSE coalesce(end_us, -1) END AS last_accessed_us FROM store"""
)
def touched_store(spark, d):
    """Counters after a search; the end of an episode stands for its last access before."""
    from mnesis.operators.recall import salience

    e = c.store(spark, d).withColumn("last_accessed_us", F.col("end_us"))
    return touch(e, salience(e), c.NOW_US).select("episode_id", F.col("access_count").cast("int").alias("access_count"), F.coalesce("last_accessed_us", F.lit(-1)).alias("last_accessed_us"))
