"""Clustering and segmentation metrics as aggregates over contingency tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnesis.functions.vectors import cosine


def _pairs(n) -> "F.Column":
    return n * (n - 1) / 2.0


def agreement(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row ``n, ari, nmi, n_true, n_pred, fragmentation``; rows with a null label are left out.

    Everything is added up from the contingency counts; 1.0 where both partitions are trivial.
    """
    cells = df.where(F.col(truth).isNotNull() & F.col(predicted).isNotNull()).groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    rows, cols = cells.groupBy("t").agg(F.sum("n").alias("n")), cells.groupBy("p").agg(F.sum("n").alias("n"))
    cell = cells.agg(F.sum(_pairs(F.col("n"))).alias("joint"), F.sum(F.col("n") * F.log("n")).alias("h_cell"), F.sum("n").alias("n"))
    a = rows.agg(F.sum(_pairs(F.col("n"))).alias("a"), F.sum(F.col("n") * F.log("n")).alias("h_a"), F.count(F.lit(1)).alias("n_true"))
    b = cols.agg(F.sum(_pairs(F.col("n"))).alias("b"), F.sum(F.col("n") * F.log("n")).alias("h_b"), F.count(F.lit(1)).alias("n_pred"))
    x = cell.crossJoin(F.broadcast(a)).crossJoin(F.broadcast(b))  # three rows in all
    n, div = F.col("n"), F.try_divide  # an empty or one-row table has no pairs
    expected = div(F.col("a") * F.col("b"), _pairs(n))
    limit = (F.col("a") + F.col("b")) / 2
    ari = F.when((limit == expected) | (n < 2), 1.0).otherwise(div(F.col("joint") - expected, limit - expected))
    h_t, h_p = F.log(n) - div(F.col("h_a"), n), F.log(n) - div(F.col("h_b"), n)
    info = F.log(n) + div(F.col("h_cell") - F.col("h_a") - F.col("h_b"), n)
    nmi = F.when((h_t + h_p) <= 1e-15, 1.0).otherwise(div(info, (h_t + h_p) / 2))
    return x.select(n.cast("bigint").alias("n"), ari.alias("ari"), nmi.alias("nmi"), "n_true", "n_pred", F.try_divide(F.col("n_pred"), F.col("n_true")).alias("fragmentation"))


def coherence(members: DataFrame, centroids: DataFrame, group: str, vec: str) -> DataFrame:
    """Mean similarity of members to their group's centroid; 1.0 for groups of one."""
    joined = members.join(centroids.select(group, "centroid", F.col("n").alias("size")), group)
    return joined.groupBy(group).agg(F.when(F.max("size") < 2, 1.0).otherwise(F.avg(cosine(vec, "centroid"))).alias("coherence"), F.max("size").alias("n"))


def calinski_harabasz(members: DataFrame, cluster: str, vec: str, dimension: int) -> DataFrame:
    """One row ``ch``: between over within variance of unit vectors, from sums per cluster and position."""
    from mnesis.functions.vectors import norm

    unit = members.withColumn("_u", F.transform(F.col(vec).cast("array<double>"), lambda x: x / norm(vec)))
    sums = [F.sum(F.col("_u")[i]) for i in range(dimension)]
    per = unit.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), F.array(*sums).alias("s"), F.sum(F.aggregate("_u", F.lit(0.0), lambda a, x: a + x * x)).alias("sq"))
    square = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)
    total = per.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum("sq").alias("sq"), F.sum(square(F.col("s")) / F.col("n")).alias("between"), square(F.array(*[F.sum(F.col("s")[i]) for i in range(dimension)])).alias("all_sq"))
    bg, wg = F.col("between") - F.col("all_sq") / F.col("n"), F.col("sq") - F.col("between")
    ch = F.when((F.col("k") < 2) | (F.col("n") <= F.col("k")) | (wg < 1e-10), 0.0).otherwise((bg / (F.col("k") - 1)) / (wg / (F.col("n") - F.col("k"))))
    return total.select(ch.alias("ch"))


def pk_windowdiff(df: DataFrame, stream: str, order: str, truth: str, predicted: str, k: int) -> DataFrame:
    """Pk and WindowDiff of two boundary columns (0/1) over windows of ``k`` rows."""
    w = Window.partitionBy(stream).orderBy(order).rowsBetween(1, k)
    x = df.withColumns({"_t": F.sum(truth).over(w), "_p": F.sum(predicted).over(w), "_n": F.count(F.lit(1)).over(w)}).where(F.col("_n") == k)
    return x.agg(
        F.count(F.lit(1)).alias("windows"), F.avg((F.col("_t") > 0).cast("int").bitwiseXOR((F.col("_p") > 0).cast("int"))).alias("pk"), F.avg((F.col("_t") != F.col("_p")).cast("int")).alias("windowdiff")
    )
