"""Messages delivered more than once: an idempotent keyed store (problem 6)."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnesis.shared import fresh_path
from mnesis.tables import micros

#: Sorted runs that the batches of one table are written to at once, by a hash of the batch.
RUNS = 4
_COLUMNS = "k1 string, k2 string, rank decimal(38,0), run string"


def canonical_id(column: str | Column) -> Column:
    """Identifier without letter case and without what surrounds it; null when nothing is left.

    Everything before the first and after the last letter or digit (white space of any kind,
    angle brackets, quotes, zero-width signs) is taken off.
    """
    c = F.col(column) if isinstance(column, str) else column
    bare = F.regexp_replace(F.lower(c), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    return F.when(bare != "", bare)


class MessageStore:
    """Hash-bucketed sorted storage of one row per identifier, a folder of sorted runs and a manifest.

    ``upsert`` writes a sorted run: the batch is collapsed to the winning row of each key (an
    aggregate that combines before the shuffle, so copies of one hot identifier never meet in one
    task as rows), laid out in hash buckets of one file each and sorted by key. A run is named by
    its batch, and writing the same batch again replaces its own run, so a repeated upsert changes
    nothing. ``compact`` merges all runs bucket by bucket: a task reads its bucket's file of every
    run, without a shuffle, and equal keys collapse to one. The manifest names the live runs and
    the number of buckets; a store opened again at its path goes on from there, and runs that a
    compaction replaced are deleted after the manifest no longer names them. The winner is the
    row with the latest ``received_at``, among equals the largest ``delivery_id``; rows without a
    time lose against rows with one.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.path = path or fresh_path(spark, "message-store")
        known = self._manifest() if path else None
        self.buckets = known[0] if known else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[str] = known[1] if known else []
        self._table = f"mnesis_store_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self._table} ({_COLUMNS}) USING parquet OPTIONS (compression 'zstd') PARTITIONED BY (run) "
            f"CLUSTERED BY (k1, k2) SORTED BY (k1, k2) INTO {self.buckets} BUCKETS LOCATION '{self.path}/runs'"
        )
        if self.runs:
            spark.catalog.recoverPartitions(self._table)

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _manifest(self) -> tuple[int, list[str]] | None:
        fs, p = self._fs(f"{self.path}/manifest")
        if not fs.exists(p):
            return None
        row = self.spark.read.schema("buckets int, runs array<string>").json(f"{self.path}/manifest").first()
        return row.buckets, list(row.runs)

    def _commit(self, runs: list[str]) -> None:
        """A new manifest replaces the old one; readers of the old one still find its runs until they are deleted."""
        self.spark.createDataFrame([(self.buckets, runs)], "buckets int, runs array<string>").coalesce(1).write.mode("overwrite").json(f"{self.path}/manifest")
        self.runs = runs

    @staticmethod
    def _collapse(rows: DataFrame, *by: str) -> DataFrame:
        # One decimal orders by (received, delivery), so the aggregate keeps a fixed-width buffer
        # and stays a hash aggregate.
        return rows.groupBy("k1", "k2", *by).agg(F.max("rank").alias("rank"))

    @staticmethod
    def _ranked(batch: DataFrame, run: Column) -> DataFrame:
        received = F.coalesce(micros("received_at"), F.lit(-1)).cast("decimal(38,0)")
        rank = received * F.expr("10000000000000000000BD") + F.col("delivery_id").cast("decimal(19,0)")
        return batch.select(
            canonical_id("channel").alias("_c"), canonical_id("message_id").alias("k2"), rank.cast("decimal(38,0)").alias("rank"), run.alias("run")
        ).select(F.coalesce("_c", F.lit("")).alias("k1"), "k2", "rank", "run").where("k2 is not null")

    def _write(self, rows: DataFrame, names: list[str]) -> None:
        for name in names:  # a run written before is replaced as a whole
            fs, p = self._fs(f"{self.path}/runs/run={name}")
            fs.delete(p, True)
        rows.repartition(self.buckets, "k1", "k2").select("k1", "k2", "rank", "run").write.insertInto(self._table)
        self.spark.catalog.refreshTable(self._table)

    def upsert(self, batch: DataFrame, batch_name: str) -> None:
        self.upsert_runs(batch, F.lit(batch_name), [batch_name])

    def upsert_runs(self, batch: DataFrame, run: Column, names: list[str]) -> None:
        """One pass over ``batch`` writes the runs ``names``; ``run`` tells the run of each row."""
        self._write(self._collapse(self._ranked(batch, run), "run"), names)
        self._commit(self.runs + [n for n in names if n not in self.runs])

    def _rows(self) -> DataFrame:
        return self.spark.table(self._table).where(F.col("run").isin(*self.runs))

    def read(self) -> DataFrame:
        """All runs, equal keys collapsed: ``k1`` (channel), ``k2`` (identifier), ``delivery_id`` of the winner."""
        winners = self._collapse(self._rows()) if len(self.runs) > 1 else self._rows()
        unit = F.expr("10000000000000000000BD")
        return winners.select("k1", "k2", F.pmod(F.col("rank"), unit).cast("bigint").alias("delivery_id"))

    def compact(self) -> None:
        """Replace the runs by one; a store with one run is compact already."""
        if len(self.runs) < 2:
            return
        name = f"base-{uuid.uuid4().hex}"
        old = self.runs
        self._collapse(self._rows()).withColumn("run", F.lit(name)).select("k1", "k2", "rank", "run").write.insertInto(self._table)
        self.spark.catalog.refreshTable(self._table)
        self._commit([name])
        for run in old:
            fs, p = self._fs(f"{self.path}/runs/run={run}")
            fs.delete(p, True)
        self.spark.catalog.refreshTable(self._table)


def dropped_copies(messages: DataFrame, store: MessageStore | None = None) -> DataFrame:
    """``delivery_id`` of every row that is not the copy to keep.

    The batches of ``messages`` go into ``RUNS`` sorted runs of the store, which are merged. Two rows
    are copies when channel and identifier are equal after ``canonical_id``. Rows whose identifier
    is null or has no letter or digit are never copies; a null channel is one channel of its own, as
    is a null batch. Repeated spellings, ties in time and empty tables have the results stated at
    ``MessageStore``. ``delivery_id`` is unique, so the final anti-join cannot be skewed.
    """
    store = store or MessageStore(messages.sparkSession)
    batch = F.col("batch_id") if "batch_id" in messages.columns else F.lit(0)
    run = F.concat(F.lit("run-"), F.pmod(F.xxhash64(batch), F.lit(RUNS)).cast("string"))
    store.upsert_runs(messages, run, [f"run-{i}" for i in range(RUNS)])
    store.compact()
    return (
        messages.where(canonical_id("message_id").isNotNull())
        .select("delivery_id")
        .join(store.read().select("delivery_id"), "delivery_id", "left_anti")
    )
