"""Registered queries of the general training-data operators (problems 2, 6 and 7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mnesis.operators.dedup import dropped_copies
from mnesis.operators.instants import normalise_timestamps
from mnesis.operators.sessions import sessionize
from mnesis.tables import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return sessionize(table(spark, d, "messages"), "conversation_id", "sent_at").select("conversation_id", "start_us", "end_us")


def p2_sessions(spark: SparkSession, d: str) -> DataFrame:
    return sessionize(table(spark, d, "messages"), "conversation_id", "sent_at")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return dropped_copies(table(spark, d, "messages"))


def p6_kept(spark: SparkSession, d: str) -> DataFrame:
    messages = table(spark, d, "messages")
    return messages.join(dropped_copies(messages), "delivery_id", "left_anti").select("delivery_id", "message_id", "channel")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return normalise_timestamps(table(spark, d, "raw_records"), table(spark, d, "channels")).select("record_id", "utc_us")


QUERIES = {f.__name__: f for f in (p2_found, p2_sessions, p6_found, p6_kept, p7_found)}

_SESSIONS = """
WITH m AS (
  SELECT conversation_id, epoch_us(sent_at) AS us FROM messages WHERE conversation_id IS NOT NULL AND sent_at IS NOT NULL
), g AS (
  SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY conversation_id ORDER BY us) <= 1800000000 THEN 0 ELSE 1 END AS opened FROM m
), s AS (
  SELECT *, sum(opened) OVER (PARTITION BY conversation_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS session FROM g
)"""
_COPIES = r"""
WITH k AS (
  SELECT delivery_id, message_id, channel, received_at,
         regexp_replace(lower(message_id), '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g') AS mid,
         regexp_replace(lower(channel), '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g') AS chan
  FROM messages
), r AS (
  SELECT *, row_number() OVER (PARTITION BY mid, coalesce(chan, '') ORDER BY received_at DESC NULLS LAST, delivery_id DESC) AS n FROM k
)"""
ORACLE = {
    "p2_found": _SESSIONS + " SELECT conversation_id, min(us) AS start_us, max(us) AS end_us FROM s GROUP BY conversation_id, session",
    "p2_sessions": _SESSIONS
    + " SELECT conversation_id, min(us) AS start_us, max(us) AS end_us, max(us) - min(us) AS duration_us, count(*) AS n_events FROM s GROUP BY conversation_id, session",
    "p6_found": _COPIES + " SELECT delivery_id FROM r WHERE mid IS NOT NULL AND mid <> '' AND n > 1",
    "p6_kept": _COPIES + " SELECT delivery_id, message_id, channel FROM r WHERE mid IS NULL OR mid = '' OR n = 1",
}
