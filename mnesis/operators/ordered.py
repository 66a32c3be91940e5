"""Order-dependent columns of long streams without one task per stream.

A stream (a conversation, an author) may hold a third of all rows. Rows are keyed by stream and
chunk of the ordering number (an hour of time by default), windows run inside chunks, and what
crosses a chunk's border is carried by a table of one row per stream and chunk, whose own window
is bounded by the stream's span over the chunk width. Window, aggregate and join share one
partitioning by (stream, chunk).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000


def _keyed(df: DataFrame, stream: str, at: str, width: int) -> DataFrame:
    # Rows without a position form a chunk of their own, the first.
    return df.withColumn("_chunk", F.coalesce(F.floor(F.col(at) / width), F.lit(-(2**62))))


def _carried(keyed: DataFrame, stream: str, summary: dict[str, Column], carry: dict[str, Column]) -> DataFrame:
    per = keyed.groupBy(F.col(stream).alias("_s"), F.col("_chunk").alias("_c")).agg(*[c.alias(n) for n, c in summary.items()])
    return per.select("_s", "_c", *[c.alias(n) for n, c in carry.items()])


def _join(keyed: DataFrame, per: DataFrame, stream: str) -> DataFrame:
    return keyed.join(per, F.col(stream).eqNullSafe(F.col("_s")) & (F.col("_chunk") == F.col("_c")), "left").drop("_s", "_c")


def previous(df: DataFrame, stream: str, at: str, tie: str, columns: dict[str, str], width: int = HOUR_US) -> DataFrame:
    """Adds for each ``new: old`` of ``columns`` the value of ``old`` in the row before (null for a stream's first)."""
    keyed = _keyed(df, stream, at, width)
    row = F.struct(*[F.col(old).alias(new) for new, old in columns.items()])
    over = Window.partitionBy("_s").orderBy("_c")
    per = _carried(keyed, stream, {"_last": F.max_by(row, F.struct(at, tie))}, {"_before": F.lag("_last").over(over)})
    inside = Window.partitionBy(stream, "_chunk").orderBy(at, tie)
    x = _join(keyed.withColumn("_lag", F.lag(row).over(inside)), per, stream)
    x = x.withColumn("_p", F.coalesce("_lag", "_before"))
    return x.withColumns({new: F.col(f"_p.{new}") for new in columns}).drop("_chunk", "_lag", "_before", "_p")


def last_known(df: DataFrame, stream: str, at: str, tie: str, column: str, new: str, width: int = HOUR_US) -> DataFrame:
    """Adds ``new``: the last value of ``column`` before the row that is not null."""
    keyed = _keyed(df, stream, at, width)
    known = F.max_by(F.col(column), F.when(F.col(column).isNotNull(), F.struct(at, tie)))
    over = Window.partitionBy("_s").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    per = _carried(keyed, stream, {"_known": known}, {"_before": F.last("_known", ignorenulls=True).over(over)})
    inside = Window.partitionBy(stream, "_chunk").orderBy(at, tie).rowsBetween(Window.unboundedPreceding, -1)
    x = _join(keyed.withColumn("_in", F.last(column, ignorenulls=True).over(inside)), per, stream)
    return x.withColumn(new, F.coalesce("_in", "_before")).drop("_chunk", "_in", "_before")


def running_sum(df: DataFrame, stream: str, at: str, tie: str, value: Column, new: str, width: int = HOUR_US) -> DataFrame:
    """Adds ``new``: the sum of ``value`` over the stream's rows up to this one."""
    keyed = _keyed(df.withColumn("_v", value.cast("bigint")), stream, at, width)
    over = Window.partitionBy("_s").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    per = _carried(keyed, stream, {"_sum": F.sum("_v")}, {"_before": F.sum("_sum").over(over)})
    inside = Window.partitionBy(stream, "_chunk").orderBy(at, tie).rowsBetween(Window.unboundedPreceding, 0)
    x = _join(keyed.withColumn("_in", F.sum("_v").over(inside)), per, stream)
    return x.withColumn(new, F.coalesce("_before", F.lit(0)) + F.col("_in")).drop("_chunk", "_v", "_in", "_before")


def row_index(df: DataFrame, stream: str, at: str, tie: str, new: str, width: int = HOUR_US) -> DataFrame:
    """Adds ``new``: the row's number in its stream, from 0."""
    x = running_sum(df, stream, at, tie, F.lit(1), new, width)
    return x.withColumn(new, F.col(new) - 1)


def in_blocks(df: DataFrame, stream: str, index: str, halo: int, size: int = 10_000) -> DataFrame:
    """Rows with ``_block`` and ``_own``: each block of ``size`` rows also holds the ``halo`` rows before it.

    Frames of up to ``halo`` preceding rows can then run in windows of (stream, block); keep the
    rows with ``_own`` afterwards.
    """
    here = F.floor(F.col(index) / size)
    blocks = F.when(F.pmod(F.col(index), F.lit(size)) >= size - halo, F.array(here, here + 1)).otherwise(F.array(here))
    return df.withColumn("_block", F.explode(blocks)).withColumn("_own", F.col("_block") == F.floor(F.col(index) / size))
