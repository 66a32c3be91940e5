"""Readers of chat exports, experiment files, dialogue corpora, gold labels and stores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ARTIFACT = "id string, timestamp timestamp, author string, content string, entities array<string>, source string, artifact_type string, importance double, true_episode_id string"
# Fixed value: the line format of the chat export.
CHAT_LINE = r"^(\d{4}-\d{2}-\d{2}), (\d{2}) h (\d{2}) - ([^:]+): (.*)"


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line_no, value``. A file is one task's input (wholetext), so its line numbers need no global order."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.split(F.regexp_replace("value", "\r\n?", "\n"), "\n").alias("lines"))
    return files.select("file", F.posexplode("lines").alias("pos", "value")).select("file", (F.col("pos") + 1).alias("line_no"), "value")


def read_chat_export(spark: SparkSession, path: str, source: str = "unknown") -> DataFrame:
    """One artifact per line of a chat export; the id is the line number. Continuation lines are dropped."""
    lines = _numbered_lines(spark, path).where(F.col("value").rlike(CHAT_LINE))
    g = lambda i: F.regexp_extract("value", CHAT_LINE, i)
    return lines.select(
        F.col("line_no").cast("string").alias("id"), F.to_timestamp(F.concat(g(1), F.lit(" "), g(2), F.lit(":"), g(3)), "yyyy-MM-dd HH:mm").alias("timestamp"), F.trim(g(4)).alias("author"), g(5).alias("content"),
        F.array().cast("array<string>").alias("entities"), F.lit(source).alias("source"), F.lit("message").alias("artifact_type"), F.lit(0.5).alias("importance"), F.lit(None).cast("string").alias("true_episode_id"),
    )


def read_experiment_csv(spark: SparkSession, path: str) -> DataFrame:
    """Experiment file: comma-separated entities are split and trimmed; missing columns get defaults."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    has = set(raw.columns)
    col = lambda name, default=None: F.coalesce(F.col(name), F.lit(default)) if name in has else F.lit(default)
    entities = F.filter(F.transform(F.split(col("entities", ""), ","), lambda x: F.trim(x)), lambda x: x != "")
    return raw.select(
        F.col("artifact_id").alias("id"), F.to_timestamp("timestamp", "yyyy-MM-dd HH:mm").alias("timestamp"), col("author", "unknown").alias("author"), col("content", "").alias("content"), entities.alias("entities"),
        col("source", "csv").alias("source"), col("artifact_type", "message").alias("artifact_type"), F.coalesce(col("importance").cast("double"), F.lit(0.5)).alias("importance"), col("true_episode_id").cast("string").alias("true_episode_id"),
    )


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """Reader by file extension, in time order (ties by id)."""
    if path.endswith(".csv"):
        df = read_experiment_csv(spark, path)
    elif path.endswith(".txt"):
        df = read_chat_export(spark, path)
    else:
        raise ValueError(f"no reader for {path}")
    return df.orderBy("timestamp", "id")


def merge_sources(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


_TURNS = "utterance string, label string, timestamp timestamp"
_BASE = "timestamp'2020-01-01 00:00:00'"


def _clock(turns: DataFrame, gap_within: int, gap_between: int, before_first: int) -> DataFrame:
    """Closed form of the synthetic clock: a minute a turn and ``gap_between`` at every dialogue change."""
    w = Window.partitionBy("file").orderBy("dialogue_no", "turn_no")
    n = F.row_number().over(w) - 1
    dialogue = F.dense_rank().over(Window.partitionBy("file").orderBy("dialogue_no")) - 1 + before_first
    minutes = n * gap_within + dialogue * gap_between
    return turns.withColumn("timestamp", F.timestamp_seconds(F.unix_seconds(F.expr(_BASE)) + minutes * 60))


def read_dialogues_json(spark: SparkSession, path: str, gap_within: int = 1, gap_between: int = 1440) -> DataFrame:
    """Dialogue corpus in JSON: ``utterance, label, timestamp``; empty dialogues are skipped."""
    schema = "dial_data map<string, array<struct<dial_id string, turns array<struct<utterance string, topic_id int>>>>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path).select(F.input_file_name().alias("file"), F.explode("dial_data").alias("set", "dialogues"))
    d = raw.select("file", "set", F.posexplode("dialogues").alias("no", "d")).select("file", F.struct("set", "no").alias("dialogue_no"), "d.dial_id", F.posexplode("d.turns").alias("turn_no", "t"))
    turns = d.select("file", "dialogue_no", "turn_no", F.col("t.utterance").alias("utterance"), F.concat("dial_id", F.lit("__topic_"), F.col("t.topic_id").cast("string")).alias("label"))
    return _clock(turns, gap_within, gap_between, 0).select("utterance", "label", "timestamp")


def read_dialogues_txt(spark: SparkSession, path: str, gap_within: int = 1, gap_between: int = 1440) -> DataFrame:
    """Dialogue corpus in text: ``call_id_*`` headers, then ``topic text`` lines."""
    lines = _numbered_lines(spark, path)
    head = F.when(F.col("value").startswith("call_id_"), F.trim("value"))
    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    x = lines.withColumns({"dial": F.last(head, ignorenulls=True).over(w), "dialogue_no": F.count(head).over(w)})
    x = x.where(head.isNull() & F.col("dial").isNotNull() & F.col("value").rlike(r"^\d+\s+\S"))
    topic, text = F.regexp_extract("value", r"^(\d+)\s+(.*)$", 1), F.regexp_extract("value", r"^(\d+)\s+(.*)$", 2)
    turns = x.select("file", "dialogue_no", F.col("line_no").alias("turn_no"), text.alias("utterance"), F.concat("dial", F.lit("__topic_"), topic).alias("label"))
    return _clock(turns, gap_within, gap_between, 1).select("utterance", "label", "timestamp")


def gold_labels(artifacts: DataFrame, gold: DataFrame, index: str = "artifact_idx") -> DataFrame:
    """Adds ``gold_episode`` from inclusive index intervals; the later interval wins where two overlap."""
    ranges = gold.select("episode_id", F.explode(F.sequence("start_idx", "end_idx")).alias(index), "start_idx")
    one = ranges.groupBy(index).agg(F.max_by("episode_id", F.struct("start_idx", "episode_id")).alias("gold_episode"))
    return artifacts.join(one, index, "left")


def chunks(artifacts: DataFrame, n: int, size: int = 50, overlap: int = 5, index: str = "artifact_idx") -> DataFrame:
    """Overlapping chunks ``chunk_no, start, end`` joined to their rows; the last is the first that reaches ``n``."""
    step = size - overlap
    starts = list(range(0, max(n, 1), step))
    ends = [min(s + size, n) for s in starts]
    keep = next((i for i, e in enumerate(ends) if e >= n), len(ends) - 1) + 1
    table = artifacts.sparkSession.range(keep).select(F.col("id").alias("chunk_no"), (F.col("id") * step).alias("start"), F.least(F.col("id") * step + size, F.lit(n)).alias("end"))
    by_row = table.select("chunk_no", "start", "end", F.explode(F.sequence("start", F.col("end") - 1)).alias(index))
    return by_row.join(artifacts, index)


def read_store(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of a saved store; without an episodes table there is no store."""
    from pyspark.errors import AnalysisException

    out = {}
    for name in ("episodes", "membership", "artifacts", "summaries", "entity_types", "links"):
        try:
            out[name] = spark.read.parquet(f"{path}/{name}")
        except AnalysisException:
            if name == "episodes":
                raise FileNotFoundError(f"no episodes in {path}") from None
    return out


def episode(store: dict[str, DataFrame], episode_id: str) -> DataFrame:
    return store["episodes"].where(F.col("episode_id") == episode_id)


def list_episodes(store: dict[str, DataFrame], status: str | None = None, limit: int = 50) -> DataFrame:
    e = store["episodes"]
    e = e.where(F.col("status") == status) if status else e
    return e.orderBy(F.col("end_time").desc_nulls_last(), "episode_id").limit(limit)


def pending_enrichment(store: dict[str, DataFrame], limit: int = 100) -> DataFrame:
    waiting = F.col("status").isin("raw", "pending_enrichment", "failed_enrichment")
    return store["episodes"].where(waiting).orderBy("end_time", "episode_id").limit(limit)
