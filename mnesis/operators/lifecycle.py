"""Episode lifecycle: decay, transitions, decisions and the nightly job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnesis.functions.scores import retention, urgency
from mnesis.functions.text import OPEN_WORDS
from mnesis.functions.vectors import cosine


def is_open(words: Column) -> Column:
    """Whether an episode's entities or title hold a word that keeps it open."""
    low = F.lower(F.coalesce(words, F.lit("")))
    return F.exists(F.array(*[F.lit(w) for w in OPEN_WORDS]), lambda w: F.contains(low, w))


def decay(episodes: DataFrame, threshold: float = 0.3, archive_days: float = 90.0) -> DataFrame:
    """Adds ``retention`` and ``new_status``: enriched ones below the threshold dormant; dormant for longer archived.

    ``episodes``: ``status, days_old, salience, access_count``. Only enriched and dormant rows decay: those that
    wait for enrichment, failed or are stale, and rows without an age, keep their status and have no retention.
    """
    kept = F.when(F.col("status").isin("enriched", "dormant"), retention(F.col("days_old"), F.coalesce("salience", F.lit(0.0)), F.coalesce("access_count", F.lit(0))))
    r = F.col("retention")
    status = (
        F.when(r.isNull(), F.col("status")).when((F.col("status") == "dormant") & (r < threshold) & (F.col("days_old") > archive_days), "archived")
        .when((F.col("status") == "enriched") & (r < threshold), "dormant").otherwise(F.col("status"))
    )
    return episodes.withColumn("retention", kept).withColumn("new_status", status)


def decisions(episodes: DataFrame, compress_days: float = 30.0, archive_days: float = 90.0, query_vec: Column | None = None) -> DataFrame:
    """``episode_id, action, score``: compress, archive, flag and surface rules over one pass of the table.

    ``episodes``: ``episode_id, state, days_old, memory, title`` and, to surface, ``centroid``. Dormant episodes
    are compressed after ``compress_days`` (six times as many while they are open), consolidated ones
    archived ``archive_days`` later; open active or dormant ones are flagged; active or dormant ones
    similar to a new artifact (``query_vec``) and important enough are surfaced. The rows' order of
    priority is by score downwards, then by action and id. A null age fires no rule on age.
    """
    open_, state = is_open(F.col("title")), F.col("state")
    due = F.when(open_, compress_days * 6).otherwise(compress_days)
    mem, age, total = F.coalesce("memory", F.lit(0.0)), F.col("days_old"), compress_days + archive_days
    alive = state.isin("ACTIVE", "DORMANT")
    act = lambda name, score: F.struct(F.lit(name).alias("action"), score.alias("score"))
    rules = [
        F.when((state == "DORMANT") & (age >= due), act("COMPRESS", urgency(age, compress_days, mem))),
        F.when((state == "CONSOLIDATED") & (age >= total), act("ARCHIVE", urgency(age, total, mem))),
        F.when(alive & open_, act("FLAG", F.round(mem, 4))),
    ]
    if query_vec is not None:
        sim = cosine(F.col("centroid"), query_vec)
        rules.append(F.when(alive & (sim >= 0.72) & (mem >= 0.35), act("SURFACE", F.round(sim * mem, 4))))
    return episodes.select("episode_id", F.explode(F.filter(F.array(*rules), lambda x: x.isNotNull())).alias("a")).select("episode_id", "a.action", "a.score")


def action_report(actions: DataFrame, most: int = 3) -> DataFrame:
    """``action, n, first``: how many actions of each kind, and the ids of the most urgent ones in order."""
    order = F.struct((-F.col("score")).alias("s"), F.col("episode_id").alias("id"))
    rank = F.row_number().over(Window.partitionBy("action").orderBy(F.col("score").desc(), "episode_id"))
    top = actions.withColumn("_rank", rank).where(F.col("_rank") <= most).groupBy("action").agg(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["id"]), ",").alias("first"))
    return actions.groupBy("action").agg(F.count(F.lit(1)).alias("n")).join(top, "action")


def apply_actions(episodes: DataFrame, actions: DataFrame, digits: int = 4) -> DataFrame:
    """Compressed episodes become consolidated, keep .85 of their memory score and fall back to their founder's vector;
    archived ones keep half the score, to ``digits`` places, and no vector. The other actions change nothing.

    ``episodes``: ``episode_id, state, memory`` and, if they are there, ``centroid`` and ``centroid_init``.
    """
    hit = actions.where("action in ('COMPRESS', 'ARCHIVE')").groupBy("episode_id").agg(F.max(F.col("action") == "ARCHIVE").alias("_arch"))
    x = episodes.join(hit, "episode_id", "left")
    arch = F.col("_arch")
    x = x.withColumn("memory", F.when(arch, F.round(F.col("memory") * 0.5, digits)).when(~arch, F.round(F.col("memory") * 0.85, digits)).otherwise(F.col("memory")))
    x = x.withColumn("state", F.when(arch, "ARCHIVED").when(~arch, "CONSOLIDATED").otherwise(F.col("state")))
    if "centroid" in x.columns:
        founder = F.col("centroid_init") if "centroid_init" in x.columns else F.lit(None)
        x = x.withColumn("centroid", F.when(arch, None).when(~arch, founder).otherwise(F.col("centroid")))
    for c in ("centroid_init", "goal_centroid"):
        if c in x.columns:
            x = x.withColumn(c, F.when(F.coalesce(arch, F.lit(False)), None).otherwise(F.col(c)))
    return x.drop("_arch")


# Allowed transitions of the lifecycle.
TRANSITIONS = [
    ("BORN", "message", "ACTIVE"), ("ACTIVE", "idle", "DORMANT"), ("DORMANT", "message", "REVIVED"), ("REVIVED", "idle", "DORMANT"), ("REVIVED", "message", "ACTIVE"),
    ("DORMANT", "fade", "COMPRESSED"), ("COMPRESSED", "message", "REVIVED"), ("COMPRESSED", "fade", "ARCHIVED"), ("ARCHIVED", "purge", "DELETED"),
]


def transition(episodes: DataFrame, state: str, event: str) -> DataFrame:
    """Adds ``next_state`` by the transition table; a pair that it lacks keeps the state."""
    table = episodes.sparkSession.createDataFrame(TRANSITIONS, "_s string, _e string, next_state string")
    joined = episodes.join(F.broadcast(table), (F.col(state) == F.col("_s")) & (F.col(event) == F.col("_e")), "left")
    return joined.withColumn("next_state", F.coalesce("next_state", F.col(state))).drop("_s", "_e")


def nightly(episodes: DataFrame) -> DataFrame:
    """Nightly job: dormant episodes older than 30 days with low retention are compressed, compressed ones beyond 90 days archived."""
    r = retention(F.col("days_old"), F.coalesce("salience", F.lit(0.0)), F.coalesce("access_count", F.lit(0)))
    status = (
        F.when((F.col("status") == "dormant") & (F.col("days_old") > 30) & (r < 0.3), "compressed")
        .when((F.col("status") == "compressed") & (F.col("days_old") > 90) & (r < 0.2), "archived").otherwise(F.col("status"))
    )
    return episodes.withColumn("new_status", status)
