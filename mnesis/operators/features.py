"""Ordered-sequence features: gaps, boundaries, islands, bursts, context windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnesis.functions.scores import gap_log
from mnesis.functions.text import is_noise
from mnesis.functions.vectors import cosine
from mnesis.operators import ordered


def previous_gap(df: DataFrame, stream: str, us: str, tie: str) -> DataFrame:
    """Adds ``gap_min`` (null for the first of a stream) and ``gap_log`` (1.0 for the first)."""
    x = ordered.previous(df, stream, us, tie, {"_us": us})
    return x.withColumn("gap_min", F.abs(F.col(us) - F.col("_us")) / 60e6).withColumn("gap_log", gap_log(F.col("gap_min"))).drop("_us")


def previous_cosine(df: DataFrame, stream: str, order: str, vec: str, width: int = 100_000) -> DataFrame:
    """Adds ``cos_prev``: similarity to the previous vector of the stream, 0 for the first."""
    x = ordered.previous(df, stream, order, order, {"_vec": vec}, width)
    return x.withColumn("cos_prev", F.coalesce(cosine(vec, "_vec"), F.lit(0.0))).drop("_vec")


def boundary_labels(df: DataFrame, stream: str, us: str, tie: str, label: str) -> DataFrame:
    """Adds ``is_boundary``: 1 where the label is known and differs from the last known one before it."""
    x = ordered.last_known(df, stream, us, tie, label, "_before_label")
    differs = F.col(label).isNotNull() & F.col("_before_label").isNotNull() & (F.col(label) != F.col("_before_label"))
    return x.withColumn("is_boundary", F.when(differs, 1).otherwise(0)).drop("_before_label")


def islands(df: DataFrame, stream: str, us: str, tie: str, gap_minutes: float) -> DataFrame:
    """Adds ``island``: numbered from 1 per stream, a new one after a gap of strictly more than ``gap_minutes``."""
    x = ordered.previous(df, stream, us, tie, {"_us": us})
    cut = F.when(F.col(us) - F.col("_us") <= int(gap_minutes * 60_000_000), 0).otherwise(1)
    return ordered.running_sum(x, stream, us, tie, cut, "island").drop("_us")


def bursts(df: DataFrame, stream: str, author: str, us: str, tie: str, text: str, seconds: int = 30, most: int = 5) -> DataFrame:
    """Merge runs of messages of one author at most ``seconds`` apart, ``most`` at a time.

    ``stream, author, start_us, end_us, n, content``: contents in order joined by `` | ``, noise left out.
    """
    x = ordered.previous(df, stream, us, tie, {"_us": us, "_author": author})
    same = (F.col("_author") == F.col(author)) & (F.col(us) - F.col("_us") <= seconds * 1_000_000)
    marked = ordered.running_sum(x, stream, us, tie, F.when(same, 0).otherwise(1), "_run")
    marked = marked.withColumn("_part", F.floor((F.row_number().over(Window.partitionBy(stream, "_run").orderBy(us, tie)) - 1) / most))
    piece = F.struct(F.col(us).alias("us"), F.col(tie).alias("tie"), F.when(~is_noise(F.col(text)), F.col(text)).alias("text"))
    texts = F.transform(F.array_sort(F.collect_list(piece)), lambda x: x["text"])
    return (
        marked.groupBy(stream, "_run", "_part")
        .agg(F.first(author).alias(author), F.min(us).alias("start_us"), F.max(us).alias("end_us"), F.count(F.lit(1)).alias("n"), F.array_join(texts, " | ").alias("content"))
        .drop("_run", "_part")
    )


def context_text(df: DataFrame, stream: str, author: str, us: str, tie: str, text: str, before: int = 4) -> DataFrame:
    """Adds ``context``: the last ``before`` messages and the current one, as one passage."""
    line = F.concat(F.lit("["), F.coalesce(F.col(author), F.lit("unknown")), F.lit("] "), F.coalesce(F.col(text), F.lit("")))
    x = ordered.in_blocks(ordered.row_index(df.withColumn("_line", line), stream, us, tie, "_i"), stream, "_i", before)
    w = Window.partitionBy(stream, "_block").orderBy("_i").rowsBetween(-before, 0)
    x = x.withColumn("context", F.concat(F.lit("passage: "), F.array_join(F.collect_list("_line").over(w), " | ")))
    return x.where("_own").drop("_line", "_i", "_block", "_own")


def gap_marker(minutes: Column) -> Column:
    return (
        F.when(minutes < 5, "").when(minutes < 60, F.concat(F.floor(minutes).cast("string"), F.lit(" min")))
        .when(minutes < 1440, F.concat(F.floor(minutes / 60).cast("string"), F.lit(" h"))).when(minutes.isNotNull(), F.concat(F.floor(minutes / 1440).cast("string"), F.lit(" jours")))
    )


def overlapping_windows(df: DataFrame, stream: str, us: str, tie: str, size: int, stride: int) -> DataFrame:
    """One row per row and window it lies in: ``window_no, at``. Windows start every ``stride`` rows of a stream."""
    numbered = ordered.row_index(df, stream, us, tie, "_i")
    first = F.greatest(F.lit(0), F.ceil((F.col("_i") - size + 1) / stride))
    last = F.floor(F.col("_i") / stride)
    return numbered.withColumn("window_no", F.explode(F.sequence(first.cast("int"), last.cast("int")))).withColumn("at", F.col("_i") - F.col("window_no") * stride).drop("_i")


def depth_scores(df: DataFrame, stream: str, order: str, score: str) -> DataFrame:
    """Adds ``depth``: half the climb from a score to its nearest peaks on both sides.

    The peak on a side is where the monotone climb ends. Expressed with windows: the climb to the
    left ends at the last row before whose predecessor is lower.
    """
    w = Window.partitionBy(stream).orderBy(order)
    s = F.col(score)
    df = df.withColumn("_l", F.when(F.lag(score).over(w) >= s, None).otherwise(F.struct(F.col(order).alias("o"), s.alias("s"))))
    df = df.withColumn("_r", F.when(F.lead(score).over(w) >= s, None).otherwise(F.struct(F.col(order).alias("o"), s.alias("s"))))
    left = F.last("_l", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    right = F.first("_r", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn("depth", 0.5 * (left["s"] + right["s"] - 2 * s)).drop("_l", "_r")


def depth_cuts(df: DataFrame, rate: float = 0.5) -> DataFrame:
    """Adds ``is_cut``: depth beyond mean plus ``rate`` standard deviations of all depths (an aggregate, joined back)."""
    level = df.agg((F.avg("depth") + rate * F.stddev_pop("depth")).alias("_level"))
    return df.crossJoin(F.broadcast(level)).withColumn("is_cut", F.col("depth") > F.col("_level")).drop("_level")


def threshold_sweep(df: DataFrame, probability: str, truth: str, thresholds: list[float]) -> DataFrame:
    """Precision, recall and F1 at each threshold.

    Rows are first counted by the highest threshold they pass, so the sweep adds up as many rows as
    there are thresholds, not thresholds times rows.
    """
    grid = sorted(thresholds)
    passed = sum((F.when(F.col(probability) >= t, 1).otherwise(0) for t in grid[1:]), F.when(F.col(probability) >= grid[0], 1).otherwise(0))
    cells = df.groupBy(passed.alias("level")).agg(F.sum(truth).alias("pos"), F.count(F.lit(1)).alias("n"))
    pairs = cells.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(len(grid)))))
    hit = F.col("level") >= F.col("k")
    at = F.element_at(F.array(*[F.lit(float(t)) for t in grid]), F.col("k"))
    sums = pairs.groupBy("k").agg(F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("n") - F.col("pos")).otherwise(0)).alias("fp"), F.sum(F.when(hit, 0).otherwise(F.col("pos"))).alias("fn"))
    sums = sums.withColumn("threshold", at)
    p, r = F.col("tp") / (F.col("tp") + F.col("fp") + 1e-8), F.col("tp") / (F.col("tp") + F.col("fn") + 1e-8)
    return sums.select("threshold", "tp", "fp", "fn", p.alias("prec"), r.alias("rec"), (2 * p * r / (p + r + 1e-8)).alias("f1"))
