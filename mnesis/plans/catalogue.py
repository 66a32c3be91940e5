"""Registered queries of the episodic-memory operators, each with the SQL that must agree."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnesis.functions import scores, sets, text, times, vectors
from mnesis.operators import components, features, graph, lifecycle, metrics, recall, segment, summarise
from mnesis.tables import micros, table

NOW_US = 1_782_864_000_000_000  # 2026-07-01, the reference time of all ages
DIM = 64
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


# ---- inputs ------------------------------------------------------------------------------------


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "value", micros("ts").alias("us"))


def artifacts(spark: SparkSession, d: str) -> DataFrame:
    """Artifacts, each exported row once."""
    a = table(spark, d, "artifacts").select("artifact_id", micros("recorded_at").alias("us"), "author", "content", "entities", "importance", "artifact_type", "source", F.col("true_episode_id").alias("episode"))
    return a.where("artifact_id is not null").dropDuplicates(["artifact_id"])


def artifact_episodes(spark: SparkSession, d: str) -> DataFrame:
    """Episodes of artifacts: hull, size, and 1 + .1 importance of every member but the founder."""
    a = artifacts(spark, d).where("episode is not null and us is not null")
    first = F.min_by(F.coalesce("importance", F.lit(0.0)), F.struct("us", "artifact_id"))
    memory = 1.0 + 0.1 * (F.sum(F.coalesce("importance", F.lit(0.0))) - first)
    return a.groupBy("episode").agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count(F.lit(1)).alias("n"), memory.alias("memory"))


def store(spark: SparkSession, d: str) -> DataFrame:
    """The episode store with ages at the reference time."""
    e = table(spark, d, "episodes")
    end = micros("end_time")
    return e.select(
        "episode_id", "status", micros("start_time").alias("start_us"), end.alias("end_us"), F.col("title_v1").alias("title"), "importance_score", "access_count", "channels", "participants", "message_count",
        F.when(vectors.is_usable("centroid_emb", DIM), F.col("centroid_emb")).alias("centroid"), ((NOW_US - end) / 3.6e9).alias("hours_old"), ((NOW_US - end) / 8.64e10).alias("days_old"),
        F.coalesce("importance_score", F.lit(0.0)).alias("memory"), F.coalesce("importance_score", F.lit(0.0)).alias("salience"), F.lit(0.0).alias("resolution"),
    )


_ARTS = """arts AS (SELECT DISTINCT artifact_id, epoch_us(recorded_at) AS us, author, content, entities, importance, artifact_type, source, true_episode_id AS episode
FROM artifacts WHERE artifact_id IS NOT NULL)"""
_AEPS = (
    _ARTS
    + """, aeps AS (SELECT episode, min(us) AS start_us, max(us) AS end_us, count(*) AS n,
  1.0 + 0.1 * (sum(coalesce(importance, 0.0)) - arg_min(coalesce(importance, 0.0), {'u': us, 'i': artifact_id})) AS memory
FROM arts WHERE episode IS NOT NULL AND us IS NOT NULL GROUP BY episode)"""
)
_STORE = f"""store AS (SELECT episode_id, status, epoch_us(start_time) AS start_us, epoch_us(end_time) AS end_us, title_v1 AS title, access_count,
  CASE WHEN len(centroid_emb) = {DIM} AND len(list_filter(centroid_emb, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(centroid_emb, lambda x: x <> 0)) > 0 THEN centroid_emb::DOUBLE[] END AS centroid,
  ({NOW_US} - epoch_us(end_time)) / 3.6e9 AS hours_old, ({NOW_US} - epoch_us(end_time)) / 8.64e10 AS days_old, coalesce(importance_score, 0.0) AS memory FROM episodes)"""
_EVENTS = "ev AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS us FROM events)"
_EDGES = (
    _ARTS
    + """, edges AS (SELECT episode, entity, count(*)::DOUBLE AS weight FROM (
  SELECT episode, unnest(list_distinct(list_filter(list_transform(coalesce(entities, []), lambda x: lower(trim(x))), lambda x: x IS NOT NULL AND x <> ''))) AS entity FROM arts WHERE episode IS NOT NULL
) GROUP BY episode, entity)"""
)


def _islands_sql(minutes: float, source: str = _EVENTS) -> str:
    us = int(minutes * 60_000_000)
    return f"""WITH {source}, cut AS (SELECT *, CASE WHEN us - lag(us) OVER w <= {us} THEN 0 ELSE 1 END AS c FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
isl AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS island FROM cut)"""


# ---- sessions and ordered features -------------------------------------------------------------

_FROM_US, _TO_US = 1_704_844_800_000_000, 1_705_017_600_000_000  # 2024-01-10 to 2024-01-12


@query(
    _islands_sql(120)
    + f""", eps AS (SELECT user_id::VARCHAR || '-' || island::BIGINT::VARCHAR AS episode_id, min(us) AS start_us, max(us) AS end_us, 1.0 + 0.1 * (count(*) - 1) AS memory FROM isl GROUP BY user_id, island),
hit AS (SELECT *, (SELECT max(memory) FROM eps) AS top FROM eps WHERE end_us >= {_FROM_US} AND start_us <= {_TO_US}),
s AS (SELECT episode_id, start_us, end_us, round(0.7 * least(greatest((least(end_us, {_TO_US}) - greatest(start_us, {_FROM_US})) / 1e6, 1.0) / least(greatest((end_us - start_us) / 1e6, 1.0), {(_TO_US - _FROM_US) / 1e6}), 1.0) + 0.3 * memory / top, 4) AS relevance FROM hit)
SELECT * FROM s ORDER BY relevance DESC, episode_id LIMIT 10"""
)
def flagship_recall_by_time(spark, d):
    x = features.islands(events(spark, d), "user_id", "us", "event_id", 120)
    eps = x.groupBy("user_id", "island").agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"), (1.0 + 0.1 * (F.count(F.lit(1)) - 1)).alias("memory"))
    eps = eps.select(F.concat_ws("-", F.col("user_id").cast("string"), F.col("island").cast("string")).alias("episode_id"), "start_us", "end_us", "memory")
    return recall.recall_by_time(eps, _FROM_US, _TO_US)


@query(_islands_sql(720) + " SELECT user_id, min(us) AS start_us, max(us) AS end_us, count(*) AS n FROM isl GROUP BY user_id, island")
def session_islands_720(spark, d):
    x = features.islands(events(spark, d), "user_id", "us", "event_id", 720)
    return x.groupBy("user_id", "island").agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count(F.lit(1)).alias("n")).drop("island")


_GAPS = f"WITH {_EVENTS}, g AS (SELECT *, abs(us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id)) / 60e6 AS gap_min FROM ev)"


@query(_GAPS + f" SELECT event_id, round(gap_min, 6) AS gap_min, round(coalesce(ln(1 + gap_min) / {math.log1p(1440.0)!r}, 1.0), 6) AS gap_log FROM g")
def gap_log_features(spark, d):
    return features.previous_gap(events(spark, d), "user_id", "us", "event_id").select("event_id", F.round("gap_min", 6).alias("gap_min"), F.round("gap_log", 6).alias("gap_log"))


@query("SELECT vec_id, round(coalesce(list_cosine_similarity(embedding::DOUBLE[], lag(embedding) OVER (PARTITION BY label ORDER BY vec_id)::DOUBLE[]), 0.0), 6) AS cos_prev FROM embeddings")
def cosine_to_previous(spark, d):
    return features.previous_cosine(table(spark, d, "embeddings"), "label", "vec_id", "embedding").select("vec_id", F.round("cos_prev", 6).alias("cos_prev"))


@query(
    f"""WITH {_ARTS}, b AS (SELECT artifact_id, episode, last_value(episode IGNORE NULLS) OVER (PARTITION BY author ORDER BY us, artifact_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM arts WHERE author IS NOT NULL AND us IS NOT NULL)
SELECT artifact_id, CASE WHEN episode IS NOT NULL AND before IS NOT NULL AND episode <> before THEN 1 ELSE 0 END AS is_boundary FROM b"""
)
def boundary_labels(spark, d):
    a = artifacts(spark, d).where("author is not null and us is not null")
    return features.boundary_labels(a, "author", "us", "artifact_id", "episode").select("artifact_id", "is_boundary")


_GRID = [round(0.1 * i, 1) for i in range(1, 10)]
_SWEEP = f", p AS (SELECT least(coalesce(ln(1 + gap_min) / {math.log1p(1440.0)!r}, 1.0), 1.0) AS p, CASE WHEN gap_min > 120 THEN 1 ELSE 0 END AS y FROM g)"


@query(
    _GAPS + _SWEEP
    + f""", t AS (SELECT unnest({_GRID}) AS threshold), c AS (SELECT t.threshold::DOUBLE AS threshold, sum(CASE WHEN p >= t.threshold::DOUBLE THEN y ELSE 0 END)::BIGINT AS tp, sum(CASE WHEN p >= t.threshold::DOUBLE THEN 1 - y ELSE 0 END)::BIGINT AS fp, sum(CASE WHEN p >= t.threshold::DOUBLE THEN 0 ELSE y END)::BIGINT AS fn FROM p, t GROUP BY 1),
r AS (SELECT *, tp / (tp + fp + 1e-8) AS prec, tp / (tp + fn + 1e-8) AS rec FROM c)
SELECT threshold, tp, fp, fn, round(prec, 6) AS prec, round(rec, 6) AS rec, round(2 * prec * rec / (prec + rec + 1e-8), 6) AS f1 FROM r"""
)
def threshold_sweep(spark, d):
    g = features.previous_gap(events(spark, d), "user_id", "us", "event_id")
    p = g.select(F.least("gap_log", F.lit(1.0)).alias("p"), F.when(F.col("gap_min") > 120, 1).otherwise(0).alias("y"))
    s = features.threshold_sweep(p, "p", "y", _GRID)
    return s.select("threshold", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("prec", "rec", "f1")])


_BINS = [0, 5, 15, 30, 60, 120, 360, 1440]


@query(_GAPS + f" SELECT list_max(list_filter({_BINS}, lambda b: b <= gap_min)) AS gap_bin, count(*) AS n, round(min(gap_min), 6) AS least, round(max(gap_min), 6) AS most FROM g WHERE gap_min IS NOT NULL GROUP BY 1")
def gap_distribution(spark, d):
    g = features.previous_gap(events(spark, d), "user_id", "us", "event_id").where("gap_min is not null")
    edge = F.array_max(F.filter(F.array(*[F.lit(b) for b in _BINS]), lambda b: b <= F.col("gap_min")))
    return g.groupBy(edge.alias("gap_bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.min("gap_min"), 6).alias("least"), F.round(F.max("gap_min"), 6).alias("most"))


@query(
    _islands_sql(120)
    + """, w AS (SELECT *, sum(c) OVER f AS t, sum(CASE WHEN us - coalesce(prev, us) > 3600000000 THEN 1 ELSE 0 END) OVER f AS p, count(*) OVER f AS n
FROM (SELECT *, lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) AS prev FROM isl) WINDOW f AS (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING))
SELECT count(*) AS windows, round(avg(CASE WHEN (t > 0) <> (p > 0) THEN 1.0 ELSE 0.0 END), 6) AS pk, round(avg(CASE WHEN t <> p THEN 1.0 ELSE 0.0 END), 6) AS windowdiff FROM w WHERE n = 5"""
)
def pk_windowdiff(spark, d):
    g = features.previous_gap(events(spark, d), "user_id", "us", "event_id").withColumn("pos", F.struct("us", "event_id"))
    g = g.withColumns({"t": F.when((F.col("gap_min") <= 120), 0).otherwise(1), "p": F.when(F.col("gap_min") > 60, 1).otherwise(0)})
    r = metrics.pk_windowdiff(g, "user_id", "pos", "t", "p", 5)
    return r.select("windows", F.round("pk", 6).alias("pk"), F.round("windowdiff", 6).alias("windowdiff"))


@query(
    f"""WITH {_EVENTS}, a AS (SELECT *, lag(value) OVER w AS pv, lead(value) OVER w AS nv FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
b AS (SELECT event_id, value,
 last_value(CASE WHEN pv >= value THEN NULL ELSE value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS l,
 first_value(CASE WHEN nv >= value THEN NULL ELSE value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS r FROM a),
c AS (SELECT event_id, 0.5 * (l + r - 2 * value) AS depth FROM b)
SELECT event_id, round(depth, 6) AS depth, depth > (SELECT avg(depth) + 0.5 * stddev_pop(depth) FROM c) AS is_cut FROM c"""
)
def depth_score_cuts(spark, d):
    e = events(spark, d).withColumn("pos", F.struct("us", "event_id"))
    return features.depth_cuts(features.depth_scores(e, "user_id", "pos", "value")).select("event_id", F.round("depth", 6).alias("depth"), "is_cut")


@query(
    f"""WITH {_EVENTS}, r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY us DESC, event_id DESC) - 1 AS back, count(*) OVER (PARTITION BY user_id) AS n FROM ev)
SELECT user_id, round(sum(CASE WHEN back = n - 1 THEN power(0.2, back) * value ELSE 0.8 * power(0.2, back) * value END), 6) AS ema FROM r GROUP BY user_id"""
)
def ema_value(spark, d):
    w = Window.partitionBy("user_id")
    r = events(spark, d).withColumns({"back": F.row_number().over(w.orderBy(F.col("us").desc(), F.col("event_id").desc())) - 1, "n": F.count(F.lit(1)).over(w)})
    term = F.when(F.col("back") == F.col("n") - 1, F.pow(F.lit(0.2), "back") * F.col("value")).otherwise(0.8 * F.pow(F.lit(0.2), "back") * F.col("value"))
    return r.groupBy("user_id").agg(F.round(F.sum(term), 6).alias("ema"))


@query(_islands_sql(math.floor(-math.log(0.30) * 120 / 2.3 * 60e6) / 60e6) + " SELECT user_id, min(us) AS start_us, max(us) AS end_us, count(*) AS n FROM isl GROUP BY user_id, island")
def greedy_segment_temporal(spark, d):
    e = events(spark, d).select(F.col("user_id").alias("stream"), F.col("event_id").alias("id"), "us", F.lit(None).cast("array<float>").alias("vec"), F.lit(None).cast("array<string>").alias("entities"), F.lit(None).cast("double").alias("boundary"))
    s = segment.segment(e, segment.temporal_only())
    return s.groupBy("stream", "session", "episode_no").agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count(F.lit(1)).alias("n")).select(F.col("stream").alias("user_id"), "start_us", "end_us", "n")


# ---- messages: text and bursts -------------------------------------------------------------------

_L = text.LETTERS
_EMOJI_SQL = text.EMOJI
_quote = lambda s: "'" + s.replace("'", "''") + "'"
_list = lambda xs: "(" + ", ".join(_quote(x) for x in xs) + ")"


def _noise_sql(c: str) -> str:
    bare = f"trim(regexp_replace(regexp_replace({c}, '{_EMOJI_SQL}', '', 'g'), '(?i)https?://\\S+', '', 'g'))"
    letters = f"regexp_replace({bare}, '[^{_L}]', '', 'g')"
    return (
        f"coalesce(length({letters}) < 4 OR regexp_replace(lower({bare}), '^[!?.,… ]+|[!?.,… ]+$', '', 'g') IN {_list(text.FILLERS)}"
        f" OR (len(list_distinct(string_split(lower({letters}), ''))) <= 2 AND length({letters}) < 10), true)"
    )


def _messages(spark, d):
    return table(spark, d, "messages").select("delivery_id", "author_id", "content", "conversation_id", "episode_id", "channel", "message_id", micros("sent_at").alias("us"))


@query(
    f"""SELECT is_noise, is_media, mood, count(*) AS n FROM (SELECT {_noise_sql('content')} AS is_noise, coalesce(regexp_matches(content, '(?i)https?://\\S+') OR length(trim(content)) < 15, false) AS is_media,
 CASE WHEN pos + neg = 0 THEN 'neutral' WHEN pos / (pos + neg) > 0.7 THEN 'positive' WHEN pos / (pos + neg) < 0.3 THEN 'negative' ELSE 'mixed' END AS mood
 FROM (SELECT content, len(list_filter({text.POSITIVE}, lambda w: contains(lower(coalesce(content, '')), w))) AS pos, len(list_filter({text.NEGATIVE}, lambda w: contains(lower(coalesce(content, '')), w))) AS neg FROM messages)) GROUP BY ALL"""
)
def message_noise_and_mood(spark, d):
    c = F.col("content")
    return _messages(spark, d).groupBy(text.is_noise(c).alias("is_noise"), F.coalesce(text.is_media(c), F.lit(False)).alias("is_media"), text.mood(c).alias("mood")).agg(F.count(F.lit(1)).alias("n"))


_MSG = "msg AS (SELECT delivery_id, author_id, content, conversation_id, epoch_us(sent_at) AS us FROM messages WHERE conversation_id IS NOT NULL AND sent_at IS NOT NULL)"


@query(
    f"""WITH {_MSG}, c AS (SELECT *, CASE WHEN lag(author_id) OVER w = author_id AND us - lag(us) OVER w <= 30000000 THEN 0 ELSE 1 END AS cut FROM msg WINDOW w AS (PARTITION BY conversation_id ORDER BY us, delivery_id)),
r AS (SELECT *, sum(cut) OVER (PARTITION BY conversation_id ORDER BY us, delivery_id ROWS UNBOUNDED PRECEDING) AS run FROM c),
k AS (SELECT *, (row_number() OVER (PARTITION BY conversation_id, run ORDER BY us, delivery_id) - 1) // 5 AS chunk FROM r)
SELECT conversation_id, max(author_id) AS author_id, min(us) AS start_us, max(us) AS end_us, count(*) AS n, coalesce(string_agg(content, ' | ' ORDER BY us, delivery_id) FILTER (WHERE NOT {_noise_sql('content')}), '') AS content FROM k GROUP BY conversation_id, run, chunk"""
)
def burst_merge(spark, d):
    m = _messages(spark, d).where("conversation_id is not null and us is not null")
    return features.bursts(m, "conversation_id", "author_id", "us", "delivery_id", "content")


@query(
    f"""WITH {_MSG} SELECT delivery_id, 'passage: ' || array_to_string(list('[' || coalesce(author_id, 'unknown') || '] ' || coalesce(content, '')) OVER (PARTITION BY conversation_id ORDER BY us, delivery_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), ' | ') AS context FROM msg"""
)
def context_window_text(spark, d):
    m = _messages(spark, d).where("conversation_id is not null and us is not null")
    return features.context_text(m, "conversation_id", "author_id", "us", "delivery_id", "content").select("delivery_id", "context")


@query(
    f"""WITH {_MSG}, i AS (SELECT conversation_id, row_number() OVER (PARTITION BY conversation_id ORDER BY us, delivery_id) - 1 AS i FROM msg),
w AS (SELECT conversation_id, i, unnest(range(greatest(0, ceil((i - 99) / 50.0))::BIGINT, (i // 50) + 1)) AS window_no FROM i)
SELECT conversation_id, window_no::INT AS window_no, count(*) AS n, max(i - window_no * 50) AS last_at FROM w GROUP BY ALL"""
)
def overlapping_windows(spark, d):
    m = _messages(spark, d).where("conversation_id is not null and us is not null")
    w = features.overlapping_windows(m, "conversation_id", "us", "delivery_id", 100, 50)
    return w.groupBy("conversation_id", "window_no").agg(F.count(F.lit(1)).alias("n"), F.max("at").cast("bigint").alias("last_at"))


def _extract_sql(kind: str) -> str:
    p = text.EXTRACTORS[kind][0]
    keep = "length(regexp_replace(value, '[^0-9]', '', 'g')) BETWEEN 7 AND 15 AND NOT regexp_matches(regexp_replace(value, '[^0-9]', '', 'g'), '^20[0-9]{6}$')" if kind == "PHONE" else "true"
    return f"SELECT '{kind}' AS kind, value, count(*) AS n FROM (SELECT unnest(regexp_extract_all(coalesce(content, ''), {_quote(p)}, 1)) AS value FROM messages) WHERE {keep} GROUP BY value"


@query(" UNION ALL ".join(_extract_sql(k) for k in text.EXTRACTORS))
def extracted_mentions(spark, d):
    m = _messages(spark, d)
    tagged = lambda kind: F.transform(text.extract(F.col("content"), kind), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    all_of = F.flatten(F.array(*[tagged(k) for k in text.EXTRACTORS]))
    return m.select(F.explode(all_of).alias("x")).groupBy("x.kind", "x.value").agg(F.count(F.lit(1)).alias("n"))


_REPEATS = "len(list_filter(range(1, greatest(length(s) - 1, 1)), lambda i: substring(s, i, 1) = substring(s, i + 1, 1) AND substring(s, i, 1) = substring(s, i + 2, 1))) > 0"


@query(
    f"""WITH f AS (SELECT DISTINCT surface_form, trim(surface_form) AS s FROM mentions WHERE surface_form IS NOT NULL), x AS (SELECT *, lower(s) AS low, regexp_split_to_array(s, '\\s+') AS w FROM f)
SELECT surface_form, coalesce(length(s) BETWEEN 2 AND 50 AND regexp_matches(s, '\\p{{L}}') AND NOT regexp_matches(s, '{_EMOJI_SQL}') AND NOT ({_REPEATS}) AND low NOT IN {_list(text.MEDIA + text.PRONOUNS + text.INTERJECTIONS)}
 AND NOT (len(w) >= 2 AND lower(w[1]) IN {_list(text.LEADING)}) AND length(regexp_replace(low, '[^{text.VOWELS}]', '', 'g')) / nullif(length(regexp_replace(low, '[^\\p{{L}}]', '', 'g')), 0) >= 0.15
 AND NOT (len(w) = 1 AND regexp_matches(s, '[0-9]')) AND len(w) <= 4, false) AS keep FROM x"""
)
def structural_filter(spark, d):
    m = table(spark, d, "mentions").where("surface_form is not null").select("surface_form").distinct()
    return m.select("surface_form", text.is_structural_entity(F.col("surface_form")).alias("keep"))


@query(
    """WITH m AS (SELECT trim(regexp_replace(regexp_replace(lower(trim(surface_form)), '[^\\p{L}\\p{N}_@. -]', '', 'g'), ' +', ' ', 'g')) AS form, surface_form, source_artifact_id, confidence, entity_type FROM mentions WHERE surface_form IS NOT NULL)
SELECT form, count(*) AS mention_count, count(DISTINCT source_artifact_id) AS n_artifacts, count(DISTINCT surface_form) AS n_aliases, round(avg(confidence), 6) AS confidence,
 arg_max(surface_form, {'s': 10 * len(regexp_split_to_array(trim(surface_form), '\\s+')) + length(surface_form) + CASE WHEN regexp_matches(surface_form, '\\p{Lu}') THEN 5 ELSE 0 END, 'f': surface_form}) AS canonical_name
FROM m WHERE form <> '' GROUP BY form"""
)
def canonical_entities_of_forms(spark, d):
    s = F.col("surface_form")
    form = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(s)), r"[^\p{L}\p{N}_@. -]", ""), " +", " "))
    m = table(spark, d, "mentions").where(s.isNotNull()).withColumn("form", form).where("form <> ''")
    return m.groupBy("form").agg(
        F.count(F.lit(1)).alias("mention_count"), F.countDistinct("source_artifact_id").alias("n_artifacts"), F.countDistinct("surface_form").alias("n_aliases"),
        F.round(F.avg("confidence"), 6).alias("confidence"), F.max_by("surface_form", F.struct(text.canonical_score(s), s)).alias("canonical_name"),
    )


@query("SELECT doc_id, CASE WHEN length(f) > 120 THEN substring(f, 1, 120) || '…' ELSE f END AS preview FROM (SELECT doc_id, replace(text, chr(10), ' ') AS f FROM documents)")
def document_previews(spark, d):
    return table(spark, d, "documents").select("doc_id", text.preview(F.col("text")).alias("preview"))


_STOP = _list(summarise.STOPWORDS)


@query(
    f"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '([a-zà-ÿ]{{3,}})', 1)) AS term FROM documents), c AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term NOT IN {_STOP} GROUP BY ALL),
n AS (SELECT count(*) AS n FROM documents), k AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM c GROUP BY term), f AS (SELECT term, ln((1 + n) / (1 + df)) + 1 AS idf FROM k, n WHERE df <= 0.85 * n ORDER BY cf DESC, term LIMIT 2000),
w AS (SELECT doc_id, term, tf * idf AS w FROM c JOIN f USING (term)), u AS (SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term) AS rank FROM u) SELECT doc_id, term, weight, rank::INT AS rank FROM r WHERE rank <= 10"""
)
def tfidf_keywords(spark, d):
    return summarise.tfidf_keywords(table(spark, d, "documents"), "doc_id", "text")


@query("SELECT lower(trim(channel)) AS channel, count(*) AS n, round(sum(coalesce(trust_weight, 0.5)), 6) AS trust FROM messages m LEFT JOIN (SELECT channel AS c, trust_weight FROM channels) c ON lower(trim(m.channel)) = c.c GROUP BY 1")
def channel_trust(spark, d):
    m = table(spark, d, "messages").select(F.lower(F.trim("channel")).alias("channel"))
    c = table(spark, d, "channels").select("channel", "trust_weight")
    return m.groupBy("channel").agg(F.count(F.lit(1)).alias("n")).join(c, "channel", "left").select("channel", "n", F.round(F.col("n") * F.coalesce("trust_weight", F.lit(0.5)), 6).alias("trust"))


# ---- vectors, centroids, metrics --------------------------------------------------------------------

_MEAN = "[" + ", ".join(f"avg(embedding[{i}]::DOUBLE)" for i in range(1, DIM + 1)) + "]"


@query(f"WITH c AS (SELECT label, {_MEAN} AS centroid, count(*) AS n FROM embeddings GROUP BY label) SELECT label, n, round(CASE WHEN n < 2 THEN 1.0 ELSE avg(list_cosine_similarity(e.embedding::DOUBLE[], centroid)) END, 6) AS coherence FROM embeddings e JOIN c USING (label) GROUP BY label, n")
def centroid_coherence(spark, d):
    e = table(spark, d, "embeddings")
    r = metrics.coherence(e, vectors.centroids(e, "label", "embedding", DIM), "label", "embedding")
    return r.select("label", "n", F.round("coherence", 6).alias("coherence"))


@query(
    """WITH p AS (SELECT episode_id AS t, conversation_id AS p FROM messages WHERE episode_id IS NOT NULL AND conversation_id IS NOT NULL), c AS (SELECT t, p, count(*)::DOUBLE AS n FROM p GROUP BY ALL),
a AS (SELECT sum(n * (n - 1) / 2) AS a, sum(n * ln(n)) AS ha, count(*) AS n_true FROM (SELECT sum(n) AS n FROM c GROUP BY t)), b AS (SELECT sum(n * (n - 1) / 2) AS b, sum(n * ln(n)) AS hb, count(*) AS n_pred FROM (SELECT sum(n) AS n FROM c GROUP BY p)),
x AS (SELECT sum(n * (n - 1) / 2) AS joint, sum(n * ln(n)) AS hc, sum(n) AS n FROM c)
SELECT n::BIGINT AS n, round((joint - a * b / (n * (n - 1) / 2)) / ((a + b) / 2 - a * b / (n * (n - 1) / 2)), 6) AS ari, round((ln(n) + hc / n - ha / n - hb / n) / ((2 * ln(n) - ha / n - hb / n) / 2), 6) AS nmi, n_true, n_pred, round(n_pred / n_true, 6) AS fragmentation FROM x, a, b"""
)
def agreement_metrics(spark, d):
    r = metrics.agreement(_messages(spark, d), "episode_id", "conversation_id")
    return r.select("n", F.round("ari", 6).alias("ari"), F.round("nmi", 6).alias("nmi"), "n_true", "n_pred", F.round("fragmentation", 6).alias("fragmentation"))


_UNIT_SUMS = ", ".join(f"sum(u[{i}]) AS s{i}" for i in range(1, DIM + 1))
_SQ = " + ".join(f"s{i} * s{i}" for i in range(1, DIM + 1))
_ALL_SQ = " + ".join(f"power(sum(s{i}), 2)" for i in range(1, DIM + 1))


@query(
    f"""WITH n AS (SELECT label, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS u FROM embeddings),
p AS (SELECT label, count(*) AS n, sum(list_dot_product(u, u)) AS sq, {_UNIT_SUMS} FROM n GROUP BY label),
t AS (SELECT sum(n) AS n, count(*) AS k, sum(sq) AS sq, sum(({_SQ}) / n) AS bt, ({_ALL_SQ}) AS al FROM p) SELECT round(((bt - al / n) / (k - 1)) / ((sq - bt) / (n - k)), 4) AS ch FROM t"""
)
def calinski_harabasz(spark, d):
    return metrics.calinski_harabasz(table(spark, d, "embeddings"), "label", "embedding", DIM).select(F.round("ch", 4).alias("ch"))


_MEMBERS = f"""mem AS (SELECT m.episode_id, epoch_us(m.sent_at) AS us, m.author_id, e.embedding FROM messages m JOIN message_embeddings e USING (message_id)
WHERE m.episode_id IS NOT NULL AND len(e.embedding) = {DIM} AND len(list_filter(e.embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e.embedding, lambda x: x <> 0)) > 0)"""


def _members(spark, d):
    e = table(spark, d, "message_embeddings").where(vectors.is_usable("embedding", DIM))
    return _messages(spark, d).where("episode_id is not null").join(e, "message_id")


@query(
    f"""WITH {_MEMBERS}, c AS (SELECT episode_id, {_MEAN} AS centroid, (max(us) - min(us)) / 60e6 AS span, count(DISTINCT author_id) AS authors, count(*) AS n FROM mem GROUP BY episode_id),
s AS (SELECT episode_id, avg(greatest(CASE WHEN list_dot_product(centroid, centroid) < 1e-18 THEN 0.0 ELSE list_cosine_similarity(mem.embedding::DOUBLE[], centroid) END, 0.0)) AS sem, avg(CASE WHEN author_id IS NULL THEN 0.0 ELSE 1.0 / authors END) AS ent, max(coalesce(exp(-0.001 * span), 1.0)) AS temp, max(n) AS n FROM mem JOIN c USING (episode_id) GROUP BY episode_id)
SELECT episode_id, n, round(sem, 4) AS semantic, round(ent, 4) AS entity, round(temp, 4) AS temporal, round(0.5 * sem + 0.3 * ent + 0.2 * temp, 4) AS cohesion FROM s"""
)
def cohesion_scores(spark, d):
    m = _members(spark, d)
    c = m.groupBy("episode_id").agg(vectors.mean_vector("embedding", DIM).alias("centroid"), ((F.max("us") - F.min("us")) / 60e6).alias("span"), F.countDistinct("author_id").alias("authors"), F.count(F.lit(1)).alias("n"))
    x = m.join(c, "episode_id").groupBy("episode_id").agg(
        F.avg(F.greatest(vectors.cosine("embedding", "centroid"), F.lit(0.0))).alias("sem"), F.avg(F.when(F.col("author_id").isNull(), 0.0).otherwise(1.0 / F.col("authors"))).alias("ent"),
        F.max(F.coalesce(F.exp(-0.001 * F.col("span")), F.lit(1.0))).alias("temp"), F.max("n").alias("n"),
    )
    r = lambda c: F.round(c, 4)
    return x.select("episode_id", "n", r("sem").alias("semantic"), r("ent").alias("entity"), r("temp").alias("temporal"), r(0.5 * F.col("sem") + 0.3 * F.col("ent") + 0.2 * F.col("temp")).alias("cohesion"))


# ---- episode-entity graph -----------------------------------------------------------------------------


def _edges(spark, d):
    return graph.edges(artifacts(spark, d), "episode", "entities")


def _query_set(e: DataFrame) -> DataFrame:
    """Episodes whose number is divisible by 50."""
    return e.select("episode").distinct().where(F.expr("try_cast(regexp_extract(episode, '([0-9]+)$', 1) as bigint) % 50 = 0"))


_QSET = "q AS (SELECT DISTINCT episode FROM edges WHERE TRY_CAST(regexp_extract(episode, '([0-9]+)$', 1) AS BIGINT) % 50 = 0)"


@query(f"WITH {_EDGES} SELECT * FROM edges")
def entity_weights(spark, d):
    return _edges(spark, d)


@query(f"WITH {_EDGES} SELECT entity, count(*) AS n_episodes, sum(weight) AS total_weight FROM edges GROUP BY entity HAVING count(*) >= 2")
def bridge_entities(spark, d):
    return graph.bridge_entities(_edges(spark, d))


@query(
    f"""WITH {_ARTS}, x AS (SELECT artifact_id, unnest(list_distinct(list_filter(list_transform(coalesce(entities, []), lambda x: lower(trim(x))), lambda x: x IS NOT NULL AND x <> ''))) AS entity FROM arts), n AS (SELECT count(*) AS n FROM arts)
SELECT entity, count(*) AS uses, round(count(*) / max(n), 6) AS freq FROM x, n GROUP BY entity HAVING count(*) >= 2 AND count(*) / max(n) <= 0.30 AND length(entity) >= 3 AND len(string_split(entity, ' ')) <= 3"""
)
def useful_entities(spark, d):
    a = artifacts(spark, d)
    n = a.agg(F.count(F.lit(1)).alias("n"))
    x = a.select(F.explode(sets.tidy_entities(F.col("entities"))).alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("uses")).crossJoin(F.broadcast(n))
    keep = (F.col("uses") >= 2) & (F.col("uses") / F.col("n") <= 0.30) & (F.length("entity") >= 3) & (F.size(F.split("entity", " ")) <= 3)
    return x.where(keep).select("entity", "uses", F.round(F.col("uses") / F.col("n"), 6).alias("freq"))


@query(
    f"""WITH {_EDGES}, {_QSET}, t AS (SELECT episode, sum(weight) AS total FROM edges GROUP BY episode), s AS (SELECT a.episode AS a, b.episode AS b, sum(a.weight + b.weight) AS joint, count(*) AS n_shared FROM edges a JOIN edges b USING (entity) WHERE a.episode IN (SELECT episode FROM q) AND a.episode <> b.episode GROUP BY 1, 2),
r AS (SELECT a, b, round(joint / (ta.total + tb.total), 6) AS similarity, n_shared FROM s JOIN t ta ON ta.episode = a JOIN t tb ON tb.episode = b), k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY similarity DESC, b) AS rank FROM r WHERE similarity >= 0.1)
SELECT a AS episode, b AS other, similarity, n_shared, rank::INT AS rank FROM k WHERE rank <= 3"""
)
def related_episodes(spark, d):
    e = _edges(spark, d)
    return graph.related(e, _query_set(e))


@query(
    f"""WITH {_EDGES}, aeps AS{_AEPS.split(', aeps AS')[1]}, {_QSET}, z AS (SELECT episode, count(*) AS size, max(memory) AS memory FROM edges JOIN aeps USING (episode) GROUP BY episode),
n AS (SELECT a.episode AS a, b.episode AS b, count(*) AS shared FROM edges a JOIN edges b USING (entity) WHERE a.episode IN (SELECT episode FROM q) AND a.episode <> b.episode GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT a AS episode, count(*) AS n_links, round(max(least(za.memory, zb.memory) * shared / (za.size + zb.size - shared)), 6) AS best_score FROM n JOIN z za ON za.episode = a JOIN z zb ON zb.episode = b GROUP BY a"""
)
def episode_links(spark, d):
    e = _edges(spark, d)
    return graph.links_of(e, artifact_episodes(spark, d).select("episode", F.col("memory").alias("memory_score")), _query_set(e))


@query(f"WITH {_EDGES} SELECT count(DISTINCT episode) AS n_episodes, count(DISTINCT entity) AS n_entities, count(*) AS n_edges, round(count(*) / (count(DISTINCT episode) * count(DISTINCT entity)), 6) AS density FROM edges")
def graph_density(spark, d):
    return graph.density(_edges(spark, d)).withColumn("density", F.round("density", 6))


@query(
    """WITH RECURSIVE l AS (SELECT DISTINCT conversation_id AS a, episode_id AS b FROM messages WHERE conversation_id IS NOT NULL AND episode_id IS NOT NULL), e AS (SELECT a AS x, b AS y FROM l UNION SELECT b, a FROM l),
r(node, reach) AS (SELECT x, x FROM e UNION SELECT r.node, e.y FROM r JOIN e ON e.x = r.reach) SELECT node, min(reach) AS component FROM r GROUP BY node"""
)
def episode_components(spark, d):
    links = _messages(spark, d).where("conversation_id is not null and episode_id is not null").select(F.col("conversation_id").alias("a"), F.col("episode_id").alias("b")).distinct()
    return components.connected_components(links)


_DORMANT = f"""{_STORE}, dor AS (SELECT s.*, e.message_count, list_distinct(list_filter(list_transform(coalesce(e.participants, []), lambda x: lower(trim(x))), lambda x: x IS NOT NULL AND x <> '')) AS ents FROM store s JOIN episodes e USING (episode_id)
WHERE s.status = 'dormant' AND s.start_us IS NOT NULL AND s.end_us IS NOT NULL AND s.centroid IS NOT NULL), jac AS (SELECT a.episode_id AS a, b.episode_id AS b, a.centroid AS ca, b.centroid AS cb, len(list_intersect(a.ents, b.ents)) AS k, len(a.ents) + len(b.ents) AS n
FROM dor a JOIN dor b ON a.episode_id < b.episode_id WHERE least(abs(b.start_us - a.end_us), abs(a.start_us - b.end_us)) / 3.6e9 <= 72),
pairs AS (SELECT a, b, round(list_cosine_similarity(ca, cb) + k / (n - k), 6) AS score FROM jac WHERE k > 0 AND k / (n - k) >= 0.30 AND list_cosine_similarity(ca, cb) >= 0.70)"""


def _dormant(spark, d):
    """Dormant episodes of the store and their edges to the participants."""
    e = store(spark, d).where("status = 'dormant'").select(F.col("episode_id").alias("episode"), "start_us", "end_us", "centroid", "participants", F.col("message_count").alias("n"), "memory")
    return e, e.select("episode", F.explode(sets.tidy_entities(F.col("participants"))).alias("entity"))


@query(f"WITH {_DORMANT} SELECT * FROM pairs")
def consolidate_pairs(spark, d):
    return segment.consolidation_pairs(*_dormant(spark, d))


@query(
    f"""WITH RECURSIVE {_DORMANT}, e AS (SELECT a AS x, b AS y FROM pairs UNION SELECT b, a FROM pairs), r(node, reach) AS (SELECT x, x FROM e UNION SELECT r.node, e.y FROM r JOIN e ON e.x = r.reach), c AS (SELECT node, min(reach) AS component FROM r GROUP BY node)
SELECT first(episode_id ORDER BY message_count DESC NULLS LAST, start_us, episode_id) AS episode_id, count(*) AS n_episodes, sum(message_count)::BIGINT AS n, min(start_us) AS start_us, max(end_us) AS end_us, round(sum(memory), 6) AS memory FROM c JOIN dor ON episode_id = node GROUP BY component"""
)
def consolidated_episodes(spark, d):
    e, edges = _dormant(spark, d)
    group = segment.consolidate(e, segment.consolidation_pairs(e, edges))
    total = [F.count(F.lit(1)).alias("n_episodes"), F.sum("n").alias("n"), F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.round(F.sum("memory"), 6).alias("memory")]
    return group.join(e, "episode").groupBy(F.col("base").alias("episode_id")).agg(*total)


# ---- recall ------------------------------------------------------------------------------------------------


def _sem(a: str, b: str) -> str:
    return f"greatest(coalesce(list_cosine_similarity({a}, {b}), 0.0), 0.0)"


@query(
    f"""WITH {_STORE}, q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0), t AS (SELECT max(memory) AS top FROM store),
s AS (SELECT query_id, episode_id, round(0.5 * {_sem('centroid', 'v')} + 0.2 * 0.0 + 0.15 * coalesce(power(2.0, -greatest(coalesce(hours_old, 1e9), 0.0) / 168.0), 0.0) + 0.15 * coalesce(CASE WHEN top > 0 THEN least(memory / top, 1.0) ELSE 0.0 END, 0.0), 4) AS relevance FROM store, q, t WHERE status <> 'archived'),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, episode_id) AS rank FROM s WHERE relevance >= 0) SELECT query_id, episode_id, relevance, rank::INT AS rank FROM r WHERE rank <= 5"""
)
def hybrid_recall_topk(spark, d):
    q = table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    return recall.recall(store(spark, d), q)


@query(f"WITH {_STORE} SELECT episode_id, round(0.6 * memory + 0.4 * power(2.0, -greatest(coalesce(hours_old, 1e9), 0.0) / 168.0), 6) AS score FROM store WHERE status <> 'archived' ORDER BY score DESC, episode_id LIMIT 10")
def salience_topk(spark, d):
    return recall.salience(store(spark, d))


@query(
    f"""WITH {_STORE}, q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0) SELECT episode_id, round(0.30 * coalesce(list_cosine_similarity(list_transform(centroid, lambda x: coalesce(x, 0.0)), v), 0.0) + 0.25 * exp(-greatest(coalesce(days_old, 1e6), 0.0) / 30.0) + 0.25 * memory + 0.05 * ln(1 + coalesce(access_count, 0)), 6) AS score
FROM store, q ORDER BY score DESC, episode_id LIMIT 5"""
)
def store_search(spark, d):
    q = table(spark, d, "embeddings").where("vec_id = 0").select(F.col("embedding").alias("query_vec"))
    return recall.store_search(store(spark, d).crossJoin(F.broadcast(q)), F.col("query_vec"))  # one row


@query(
    f"""WITH {_EDGES}, aeps AS{_AEPS.split(', aeps AS')[1]}, b AS (SELECT episode, weight, end_us, memory, max(weight) OVER () AS w, max(memory) OVER () AS m FROM edges JOIN aeps USING (episode) WHERE entity = 'budget')
SELECT episode, round(0.5 * weight / w + 0.3 * power(2.0, -greatest(({NOW_US} - end_us) / 3.6e9, 0.0) / 168.0) + 0.2 * memory / m, 4) AS relevance FROM b ORDER BY relevance DESC, episode LIMIT 5"""
)
def recall_by_entity(spark, d):
    hit = _edges(spark, d).where("entity = 'budget'").join(artifact_episodes(spark, d), "episode")
    top = hit.agg(F.max("weight").alias("w"), F.max("memory").alias("m"))
    score = 0.5 * F.col("weight") / F.col("w") + 0.3 * scores.half_life_recency((NOW_US - F.col("end_us")) / 3.6e9) + 0.2 * F.col("memory") / F.col("m")
    return hit.crossJoin(F.broadcast(top)).select("episode", F.round(score, 4).alias("relevance")).orderBy(F.col("relevance").desc(), "episode").limit(5)


@query(
    f"""WITH {_STORE}, q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0), l AS (SELECT * FROM store WHERE status = 'dormant' AND end_us IS NOT NULL ORDER BY end_us DESC, episode_id LIMIT 20)
SELECT episode_id, round({_sem('centroid', 'v')}, 6) AS similarity FROM l, q WHERE centroid IS NOT NULL ORDER BY similarity DESC, episode_id LIMIT 1"""
)
def dormant_match(spark, d):
    q = table(spark, d, "embeddings").where("vec_id = 0").select(F.col("embedding").alias("query_vec"))
    latest = store(spark, d).where("status = 'dormant' and end_us is not null").orderBy(F.col("end_us").desc(), "episode_id").limit(20)
    sim = F.greatest(vectors.cosine("centroid", "query_vec"), F.lit(0.0))
    return latest.where("centroid is not null").crossJoin(F.broadcast(q)).select("episode_id", F.round(sim, 6).alias("similarity")).orderBy(F.col("similarity").desc(), "episode_id").limit(1)


# ---- lifecycle ------------------------------------------------------------------------------------------------

_RET = "exp(-(0.1 / (1 + memory)) * days_old / (1 + ln(1 + coalesce(access_count, 0))))"


@query(
    f"""WITH {_STORE}, r AS (SELECT *, CASE WHEN status IN ('enriched', 'dormant') THEN {_RET} END AS ret FROM store) SELECT episode_id, round(ret, 6) AS retention, CASE WHEN status = 'dormant' AND ret < 0.3 AND days_old > 90 THEN 'archived' WHEN status = 'enriched' AND ret < 0.3 THEN 'dormant' ELSE status END AS new_status FROM r"""
)
def retention_decay(spark, d):
    return lifecycle.decay(store(spark, d)).select("episode_id", F.round("retention", 6).alias("retention"), "new_status")


@query(
    f"""WITH {_STORE}, r AS (SELECT *, {_RET} AS ret FROM store) SELECT episode_id, CASE WHEN status = 'dormant' AND days_old > 30 AND ret < 0.3 THEN 'compressed' WHEN status = 'compressed' AND days_old > 90 AND ret < 0.2 THEN 'archived' ELSE status END AS new_status FROM r"""
)
def nightly_consolidation(spark, d):
    return lifecycle.nightly(store(spark, d)).select("episode_id", "new_status")


_OPEN = "len(list_filter([" + ", ".join(_quote(w) for w in text.OPEN_WORDS) + "], lambda w: contains(lower(coalesce(title, '')), w))) > 0"
_STATES = f"""{_STORE}, st AS (SELECT *, CASE WHEN status = 'archived' AND days_old < 400 THEN 'CONSOLIDATED' WHEN status = 'archived' THEN 'ARCHIVED' WHEN status = 'dormant' THEN 'DORMANT' ELSE 'ACTIVE' END AS state FROM store)"""
_ACTIONS = f"""act AS (
 SELECT episode_id, 'COMPRESS' AS action, round(least(1.0, days_old / 30.0 * (1 - 0.4 * memory)), 4) AS score FROM st WHERE state = 'DORMANT' AND days_old >= CASE WHEN {_OPEN} THEN 180.0 ELSE 30.0 END
 UNION ALL SELECT episode_id, 'ARCHIVE', round(least(1.0, days_old / 120.0 * (1 - 0.4 * memory)), 4) FROM st WHERE state = 'CONSOLIDATED' AND days_old >= 120.0
 UNION ALL SELECT episode_id, 'FLAG', round(memory, 4) FROM st WHERE state IN ('ACTIVE', 'DORMANT') AND {_OPEN}
 UNION ALL SELECT episode_id, 'SURFACE', round(sim * memory, 4) FROM (SELECT st.*, list_cosine_similarity(centroid, v) AS sim FROM st, (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0)) WHERE state IN ('ACTIVE', 'DORMANT') AND sim >= 0.72 AND memory >= 0.35)"""


def _states(spark, d):
    """Episodes with a state. The store has no consolidated ones: those archived in the last 400 days stand for them."""
    e = store(spark, d)
    archived = F.col("status") == "archived"
    state = F.when(archived & (F.col("days_old") < 400), "CONSOLIDATED").when(archived, "ARCHIVED").when(F.col("status") == "dormant", "DORMANT").otherwise("ACTIVE")
    new = table(spark, d, "embeddings").where("vec_id = 0").select(F.col("embedding").alias("query_vec"))
    return e.withColumn("state", state).crossJoin(F.broadcast(new))  # one row


@query(f"WITH {_STATES}, {_ACTIONS} SELECT * FROM act")
def decision_actions(spark, d):
    return lifecycle.decisions(_states(spark, d), query_vec=F.col("query_vec"))


@query(
    f"""WITH {_STATES}, {_ACTIONS}, r AS (SELECT *, row_number() OVER (PARTITION BY action ORDER BY score DESC, episode_id) AS rank FROM act)
SELECT action, count(*) AS n, string_agg(episode_id, ',' ORDER BY rank) FILTER (WHERE rank <= 3) AS first FROM r GROUP BY action"""
)
def decision_report(spark, d):
    return lifecycle.action_report(lifecycle.decisions(_states(spark, d), query_vec=F.col("query_vec")))


@query(
    f"""WITH {_STATES}, {_ACTIONS}, h AS (SELECT episode_id, bool_or(action = 'ARCHIVE') AS arch FROM act WHERE action IN ('COMPRESS', 'ARCHIVE') GROUP BY episode_id)
SELECT episode_id, CASE WHEN arch THEN 'ARCHIVED' WHEN NOT arch THEN 'CONSOLIDATED' ELSE state END AS state, CASE WHEN arch THEN round(memory * 0.5, 6) WHEN NOT arch THEN round(memory * 0.85, 6) ELSE memory END AS memory, centroid IS NOT NULL AND arch IS NULL AS has_vector FROM st LEFT JOIN h USING (episode_id)"""
)
def applied_actions(spark, d):
    e = _states(spark, d)
    done = lifecycle.apply_actions(e, lifecycle.decisions(e), digits=6)
    return done.select("episode_id", "state", "memory", F.col("centroid").isNotNull().alias("has_vector"))


@query(
    f"""WITH {_STORE} SELECT episode_id, CASE WHEN end_us IS NULL THEN 'ACTIVE' WHEN hours_old > 24 THEN 'DORMANT' ELSE 'ACTIVE' END AS next_state FROM store"""
)
def lifecycle_transitions(spark, d):
    e = store(spark, d).select("episode_id", F.lit("ACTIVE").alias("state"), F.when(F.col("hours_old") > 24, "idle").otherwise("none").alias("event"))
    return lifecycle.transition(e, "state", "event").select("episode_id", "next_state")


@query(
    """SELECT coalesce(status, 'total') AS status, count(*) AS n, round(avg(importance_score), 6) AS importance FROM episodes WHERE status IS NOT NULL GROUP BY ROLLUP (status)"""
)
def status_counts(spark, d):
    e = table(spark, d, "episodes").where("status is not null")
    return e.rollup("status").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("importance_score"), 6).alias("importance")).withColumn("status", F.coalesce("status", F.lit("total")))


@query(f"WITH {_STORE} SELECT episode_id, round(power(2.0, -greatest(hours_old, 0.0) / 168.0), 6) AS recency, round(exp(-greatest(days_old, 0.0) / 30.0), 6) AS monthly FROM store WHERE end_us IS NOT NULL")
def recency_scores(spark, d):
    e = store(spark, d).where("end_us is not null")
    return e.select("episode_id", F.round(scores.half_life_recency(F.col("hours_old")), 6).alias("recency"), F.round(scores.monthly_recency(F.col("days_old")), 6).alias("monthly"))


_D = "[" + ", ".join(_quote(x) for x in times.DAYS) + "]"
_M = "[" + ", ".join(_quote(x) for x in times.MONTHS) + "]"
_PERIOD = "CASE " + " ".join(f"WHEN hour(s) < {h} THEN {_quote(n)}" for h, n in times.PERIODS) + " END"


@query(
    f"""WITH x AS (SELECT episode_id, start_time AS s, end_time AS e, date_diff('second', date_trunc('second', start_time), date_trunc('second', start_time) + (end_time - start_time)) / 3600.0 AS h, {_D}[isodow(start_time)] AS dn, {_M}[month(start_time)] AS mn FROM episodes)
SELECT episode_id, CASE WHEN s IS NULL OR e IS NULL THEN 'date inconnue' WHEN h < 0.1 THEN dn || ' ' || day(s) || ' ' || mn || ' à ' || lpad(hour(s)::VARCHAR, 2, '0') || 'h' || lpad(minute(s)::VARCHAR, 2, '0')
 WHEN h < 24 THEN {_PERIOD} || ' du ' || dn || ' ' || day(s) || ' ' || mn WHEN h < 48 THEN dn || ' ' || day(s) || '–' || day(e) || ' ' || mn WHEN month(s) = month(e) THEN day(s) || '–' || day(e) || ' ' || mn ELSE day(s) || ' ' || mn || ' – ' || day(e) || ' ' || {_M}[month(e)] END AS label FROM x"""
)
def time_labels(spark, d):
    return table(spark, d, "episodes").select("episode_id", times.time_label(F.col("start_time").cast("timestamp_ntz"), F.col("end_time").cast("timestamp_ntz")).alias("label"))


@query(
    f"""WITH {_STORE} SELECT episode_id, CASE WHEN days_old < 1 THEN 'aujourd''hui' WHEN days_old < 2 THEN 'hier' WHEN days_old < 7 THEN 'il y a ' || floor(days_old)::BIGINT || ' jours' WHEN days_old < 30 THEN 'il y a ' || floor(days_old / 7)::BIGINT || ' semaines'
 WHEN days_old < 365 THEN 'il y a ' || floor(days_old / 30)::BIGINT || ' mois' WHEN days_old IS NOT NULL THEN 'il y a ' || floor(days_old / 365)::BIGINT || ' ans' END AS label FROM store"""
)
def age_labels(spark, d):
    return store(spark, d).select("episode_id", times.age_label(F.col("days_old")).alias("label"))


# ---- episode aggregates and statistics ---------------------------------------------------------------------------


@query(f"WITH {_AEPS} SELECT episode, start_us, end_us, n, round(memory, 6) AS memory FROM aeps")
def memory_scores(spark, d):
    return artifact_episodes(spark, d).withColumn("memory", F.round("memory", 6))


@query(f"WITH {_AEPS} SELECT CASE WHEN n >= 100 THEN 100 ELSE list_max(list_filter([1, 2, 3, 5, 8, 12, 20], lambda b: b <= n)) END AS size_bin, count(*) AS n_episodes, sum(n)::BIGINT AS n_artifacts FROM aeps GROUP BY 1")
def episode_size_histogram(spark, d):
    edge = F.when(F.col("n") >= 100, 100).otherwise(F.array_max(F.filter(F.array(*[F.lit(b) for b in (1, 2, 3, 5, 8, 12, 20)]), lambda b: b <= F.col("n"))))
    return artifact_episodes(spark, d).groupBy(edge.alias("size_bin")).agg(F.count(F.lit(1)).alias("n_episodes"), F.sum("n").alias("n_artifacts"))


@query(f"WITH {_AEPS} SELECT episode, n, round((end_us - start_us) / 3.6e9, 4) AS span_hours FROM aeps WHERE n >= 8 AND (end_us - start_us) / 3.6e9 > 48")
def split_candidates(spark, d):
    span = (F.col("end_us") - F.col("start_us")) / 3.6e9
    return artifact_episodes(spark, d).where((F.col("n") >= 8) & (span > 48)).select("episode", "n", F.round(span, 4).alias("span_hours"))


@query(
    f"""WITH m AS (SELECT episode_id, lower(trim(channel)) AS channel, author_id, epoch_us(sent_at) AS us, delivery_id FROM messages WHERE episode_id IS NOT NULL AND sent_at IS NOT NULL), f AS (SELECT episode_id, channel, min({{'u': us, 'd': delivery_id}}) AS f FROM m WHERE channel IS NOT NULL GROUP BY ALL)
SELECT episode_id, string_agg(channel, ',' ORDER BY f) AS channels, count(*) AS n_channels FROM f GROUP BY episode_id"""
)
def channels_of_episodes(spark, d):
    m = _messages(spark, d).where("episode_id is not null and us is not null and channel is not null").withColumn("channel", F.lower(F.trim("channel")))
    first = m.groupBy("episode_id", "channel").agg(F.min(F.struct("us", "delivery_id")).alias("f"))
    order = F.array_sort(F.collect_list(F.struct("f", "channel")))
    return first.groupBy("episode_id").agg(F.array_join(F.transform(order, lambda x: x["channel"]), ",").alias("channels"), F.count(F.lit(1)).alias("n_channels"))


@query(
    """SELECT source, artifact_type, count(*) AS n, count(DISTINCT author) AS n_authors, round(avg(importance), 6) AS importance FROM (SELECT DISTINCT artifact_id, source, artifact_type, author, importance FROM artifacts WHERE artifact_id IS NOT NULL) GROUP BY ALL"""
)
def dataset_statistics(spark, d):
    return artifacts(spark, d).groupBy("source", "artifact_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("author").alias("n_authors"), F.round(F.avg("importance"), 6).alias("importance"))


@query(f"WITH {_STORE} SELECT episode_id, title FROM store WHERE status <> 'archived' AND {_OPEN}")
def open_episodes(spark, d):
    return store(spark, d).where("status <> 'archived'").where(lifecycle.is_open(F.col("title"))).select("episode_id", "title")


@query(f"WITH {_STORE} SELECT date_trunc('month', make_timestamp(start_us))::DATE AS month, count(*) AS n, sum(CASE WHEN status = 'dormant' THEN 1 ELSE 0 END)::BIGINT AS dormant FROM store WHERE start_us IS NOT NULL GROUP BY 1")
def timeline(spark, d):
    e = store(spark, d).where("start_us is not null")
    month = F.trunc(F.expr("date_add(date'1970-01-01', cast(floor(start_us / 86400000000) as int))"), "month")
    return e.groupBy(month.alias("month")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("status") == "dormant", 1).otherwise(0)).alias("dormant"))


# ---- sequential operators on messages with vectors (no SQL: order-dependent folds) --------------------------------


def _segment_input(spark, d):
    e = table(spark, d, "message_embeddings").where(vectors.is_usable("embedding", DIM))
    m = _messages(spark, d).where("conversation_id is not null and us is not null").join(e, "message_id", "left")
    return m.select(F.col("conversation_id").alias("stream"), F.col("delivery_id").alias("id"), "us", F.col("embedding").alias("vec"), F.lit(None).cast("array<string>").alias("entities"), F.lit(None).cast("double").alias("boundary"))


@query()
def greedy_segment(spark, d):
    return segment.segment(_segment_input(spark, d), segment.SegmentConfig(hard_break_minutes=720))


@query()
def hybrid_segment(spark, d):
    x = features.previous_gap(_segment_input(spark, d).drop("boundary"), "stream", "us", "id")
    return segment.segment(x.withColumn("boundary", F.least("gap_log", F.lit(1.0))), segment.SegmentConfig(boundary_gate=0.5, hard_break_minutes=720))


def _segmented(spark, d):
    s = segment.segment(_segment_input(spark, d), segment.SegmentConfig(hard_break_minutes=720)).select("stream", "id", F.concat_ws("-", "session", "episode_no").alias("episode"))
    return _segment_input(spark, d).join(s, ["stream", "id"])


@query()
def merge_small_episodes(spark, d):
    m = _segmented(spark, d).where("vec is not null")
    eps = m.groupBy("stream", F.col("episode").alias("episode_no")).agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count(F.lit(1)).alias("n"), vectors.mean_vector("vec", DIM).alias("centroid"))
    return segment.merge_small(eps)


@query()
def split_large_episodes(spark, d):
    return segment.split_large(_members(spark, d).where("us is not null").select(F.col("episode_id").alias("episode"), F.col("delivery_id").alias("id"), "us", F.col("embedding").alias("vec")))


@query()
def reassigned_messages(spark, d):
    m = _segmented(spark, d).where("vec is not null")
    return segment.reassign(m.select("stream", "id", "us", "vec", "entities"), m.select("stream", "id", "episode"), DIM)
