"""Grouping activity into sessions separated by inactivity (problem 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnesis.tables import micros

GAP_US = 30 * 60 * 1_000_000


def partial_sessions(events: DataFrame, entity: str, time: str, gap_us: int = GAP_US) -> DataFrame:
    """Local sessions of each (entity, time chunk).

    Chunks are exactly ``gap_us`` long, so no two events of a chunk can be more than the gap
    apart and a chunk holds one partial session: its first and last time and its count. That is
    a plain aggregate which combines before the shuffle, so an entity that owns a third of all
    rows costs no more than one row per chunk and map task.
    """
    us = F.col("_us")
    return (
        events.select(F.col(entity).alias("_entity"), micros(time).alias("_us"))
        .where(F.col("_entity").isNotNull() & us.isNotNull())
        .groupBy("_entity", ((us - F.pmod(us, F.lit(gap_us))) / F.lit(gap_us)).cast("bigint").alias("_chunk"))
        .agg(F.min("_us").alias("_lo"), F.max("_us").alias("_hi"), F.count(F.lit(1)).alias("_n"))
    )


def merge_partials(partials: DataFrame, gap_us: int = GAP_US) -> DataFrame:
    """Merge partial sessions whose boundary gap is at most ``gap_us``.

    Input is one row per entity and chunk, so an entity's window holds at most its time span
    divided by the gap, however many events it has.
    """
    w = Window.partitionBy("_entity").orderBy("_chunk")
    opened = F.when(F.col("_lo") - F.lag("_hi").over(w) <= gap_us, 0).otherwise(1)
    return (
        partials.withColumn("_open", opened)
        .withColumn("_session", F.sum("_open").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("_entity", "_session")
        .agg(F.min("_lo").alias("start_us"), F.max("_hi").alias("end_us"), F.sum("_n").alias("n_events"))
    )


def sessionize(events: DataFrame, entity: str, time: str, gap_us: int = GAP_US) -> DataFrame:
    """Sessions per entity: ``entity, start_us, end_us, duration_us, n_events``.

    A session begins when strictly more than ``gap_us`` have passed since the entity's previous
    event; a gap of exactly ``gap_us`` continues it. Rows with a null entity or time take no part.
    Ties and repeated rows count as events of the same session. An empty input gives an empty
    result. Other columns of ``events`` are never read, so clashing names do no harm.
    """
    merged = merge_partials(partial_sessions(events, entity, time, gap_us), gap_us)
    return merged.select(
        F.col("_entity").alias(entity), "start_us", "end_us", (F.col("end_us") - F.col("start_us")).alias("duration_us"), "n_events"
    )
