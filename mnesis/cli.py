"""``python -m mnesis.cli build|recall|summary``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from mnesis.agent import build_context
from mnesis.functions.vectors import hashing_embedding
from mnesis.operators.recall import recall
from mnesis.pipeline import build, evaluate
from mnesis.sources.readers import read_store


def _recall_table(store: dict):
    e = store["episodes"]
    now = e.agg(F.max("end_us").alias("_now"))
    return e.crossJoin(F.broadcast(now)).withColumn("hours_old", (F.col("_now") - F.col("end_us")) / 3.6e9)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> str:
    p = argparse.ArgumentParser(prog="mnesis")
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build", help="build a memory from chat exports and experiment files")
    b.add_argument("paths", nargs="+")
    b.add_argument("--store", required=True)
    r = sub.add_parser("recall", help="episodes for a query")
    r.add_argument("store")
    r.add_argument("query")
    r.add_argument("--top-k", type=int, default=5)
    s = sub.add_parser("summary", help="counts of a stored memory")
    s.add_argument("store")
    args = p.parse_args(argv)
    spark = spark or SparkSession.builder.appName("mnesis").getOrCreate()
    if args.command == "build":
        tables = build(spark, args.paths, args.store)
        x = evaluate(tables).collect()[0]
        return f"{tables['episodes'].count()} episodes; agreement with labels: ARI {x.ari}, NMI {x.nmi}"
    store = read_store(spark, args.store)
    if args.command == "summary":
        return "\n".join(f"{x.status}: {x['count']}" for x in store["episodes"].groupBy("status").count().orderBy("status").collect())
    q = spark.range(1).select(F.lit(1).alias("query_id"), hashing_embedding(F.lit(args.query)).alias("query_vec"))
    best = recall(_recall_table(store), q, args.top_k).join(store["summaries"], "episode_id").orderBy("rank").limit(args.top_k)
    return build_context([x.asDict() for x in best.collect()])


if __name__ == "__main__":
    print(main())
