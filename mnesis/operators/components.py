"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnesis.shared import materialise


def connected_components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``node, component``: the smallest node that each node of ``links`` is linked to.

    Smallest-label propagation with pointer jumping: a round takes over the smallest label of all
    neighbours and then that label's own label, so chains close in a logarithmic number of rounds;
    rounds go on until no label changes, which must come, as labels only ever fall.
    Both steps are aggregates and equi-joins; each round is written to the shared folder, which
    cuts the lineage. Links with a null end are ignored; loops and repeated links do no harm.
    """
    a, b = F.col(left), F.col(right)
    clean = links.where(a.isNotNull() & b.isNotNull()).select(a.alias("x"), b.alias("y"))
    edges = materialise(clean.unionByName(clean.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "links")
    labels = materialise(edges.groupBy("x").agg(F.min(F.least("x", "y")).alias("label")).withColumnRenamed("x", "node"), "labels")
    while True:
        offered = (
            edges.join(labels, edges["y"] == labels["node"]).select(F.col("x").alias("node"), "label")
            .unionByName(labels).groupBy("node").agg(F.min("label").alias("label"))
        )
        jump = offered.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = materialise(
            offered.join(jump, "label", "left").select("node", F.least("label", F.coalesce("next", "label")).alias("label")), "labels"
        )
        changed = new.join(labels.withColumnRenamed("label", "old"), "node").where("label <> old").limit(1).count()
        labels = new
        if not changed:
            return labels.withColumnRenamed("label", "component")
