"""Reading the project's Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory (a file or a directory of part files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column) -> "F.Column":
    """Microseconds since 1970 UTC of a timestamp column, with or without zone.

    Zone-less values stand for UTC, whatever the session's time zone is.
    """
    c = F.col(column) if isinstance(column, str) else column
    ntz = c.cast("timestamp_ntz")
    epoch = F.expr("timestamp_ntz'1970-01-01 00:00:00'")
    return F.timestamp_diff("MICROSECOND", epoch, ntz)
