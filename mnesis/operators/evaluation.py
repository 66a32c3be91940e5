"""Boundary evaluation, retrieval metrics, annotation sets and the trained boundary model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnesis.functions import text, vectors
from mnesis.functions.scores import length_log
from mnesis.operators import features, ordered


def predicted_boundaries(membership: DataFrame, episode: str, index: str) -> DataFrame:
    """First index of every episode but the one that begins the stream."""
    return membership.groupBy(episode).agg(F.min(index).alias("boundary")).where("boundary > 0").select("boundary").distinct()


def boundary_cases(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """``boundary, kind``: TP, FP and FN of two boundary sets."""
    g, p = gold.select("boundary").distinct().withColumn("_g", F.lit(1)), predicted.select("boundary").distinct().withColumn("_p", F.lit(1))
    kind = F.when(F.col("_g").isNotNull() & F.col("_p").isNotNull(), "TP").when(F.col("_g").isNull(), "FP").otherwise("FN")
    return g.join(p, "boundary", "full_outer").select("boundary", kind.alias("kind"))


def boundary_prf(cases: DataFrame) -> DataFrame:
    """One row ``tp, fp, fn, prec, rec, f1``; 0 where there is nothing to divide by."""
    n = lambda k: F.count_if(F.col("kind") == k)
    c = cases.agg(n("TP").alias("tp"), n("FP").alias("fp"), n("FN").alias("fn"))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    p, r = zero(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))), zero(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")))
    return c.withColumns({"prec": p, "rec": r, "f1": zero(F.try_divide(2 * p * r, p + r))})


def sample_cases(cases: DataFrame, n: int = 5, seed: int = 42) -> DataFrame:
    """At most ``n`` cases of each kind (the size is the feature), drawn by a seeded hash."""
    w = Window.partitionBy("kind").orderBy(F.xxhash64(F.lit(seed), "boundary"), "boundary")
    return cases.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def retrieval_metrics(ranked: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """``recall_at_k`` for each k and ``mrr``: ``ranked(query_id, item_id, rank)`` against ``relevant(query_id, item_id)``."""
    hits = relevant.distinct().join(ranked, ["query_id", "item_id"], "left")
    per = hits.groupBy("query_id").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("rank") <= k).alias(f"h{k}") for k in ks])
    return per.agg(*[F.avg(F.col(f"h{k}") / F.col("n")).alias(f"recall_at_{k}") for k in ks], F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"))


def keep_large(membership: DataFrame, episode: str, least: int) -> DataFrame:
    """Rows of episodes with at least ``least`` members."""
    big = membership.groupBy(episode).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select(episode)
    return membership.join(big, episode, "left_semi")


def silver_boundaries(chunk_boundaries: DataFrame, chunk_bounds: DataFrame) -> DataFrame:
    """Boundaries found per chunk, those inside their chunk, united over the overlaps."""
    j = chunk_boundaries.join(chunk_bounds, "chunk_no").where((F.col("boundary") >= F.col("start")) & (F.col("boundary") < F.col("end")))
    return j.select("boundary").distinct()


def reviewed_boundaries(silver: DataFrame, gaps: DataFrame, confirmed: DataFrame, hours: float = 2.0) -> DataFrame:
    """Boundaries approved by a gap of at least ``hours`` to the next row (the last row always), or by a person."""
    auto = silver.join(gaps.select(F.col("artifact_idx").alias("boundary"), "next_gap_hours"), "boundary", "left").where(F.coalesce("next_gap_hours", F.lit(999.0)) >= hours)
    return auto.select("boundary").union(confirmed.select("boundary")).distinct()


def importance(importance_parts: list[Column], weights: list[float]) -> Column:
    return sum((w * F.coalesce(c, F.lit(0.0)) for c, w in zip(importance_parts[1:], weights[1:])), weights[0] * F.coalesce(importance_parts[0], F.lit(0.0)))


def novelty(best_similarity: Column) -> Column:
    return 1 - F.greatest(F.coalesce(best_similarity, F.lit(0.0)), F.lit(0.0))


FEATURES = ["cos_prev", "gap_log", "length_log", "is_media", "author_change"]


def boundary_features(rows: DataFrame, stream: str, us: str, tie: str, author: str, content: str, vec: str) -> DataFrame:
    """Adds the boundary features of each row against the one before it in its stream."""
    x = ordered.previous(rows, stream, us, tie, {"_pv": vec, "_pa": author})
    x = features.previous_gap(x, stream, us, tie)
    flag = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    return x.withColumns({
        "cos_prev": F.coalesce(vectors.cosine(vec, "_pv"), F.lit(0.0)), "length_log": F.coalesce(length_log(F.col(content)), F.lit(0.0)), "is_media": flag(text.is_media(F.col(content))), "author_change": flag(F.col(author) != F.col("_pa")),
    }).drop("_pv", "_pa")


def train_boundary_model(featured: DataFrame, label: str, hidden: int | None = None):
    """A boundary classifier on ``FEATURES`` with classes weighed by their rarity; logistic regression, or one hidden layer."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
    from pyspark.ml.feature import VectorAssembler

    counts = featured.agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")).collect()[0]
    weighed = featured.withColumn("_w", F.when(F.col(label) == 1, float(counts.neg) / max(counts.pos, 1)).otherwise(1.0)).withColumn("_y", F.col(label).cast("double"))
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="_f")
    if hidden:
        model = MultilayerPerceptronClassifier(layers=[len(FEATURES), hidden, 2], featuresCol="_f", labelCol="_y", seed=1)
    else:
        model = LogisticRegression(featuresCol="_f", labelCol="_y", weightCol="_w", maxIter=30)
    return Pipeline(stages=[assembler, model]).fit(weighed)


def boundary_probability(model, featured: DataFrame) -> DataFrame:
    """Adds ``boundary``, the probability that a row begins an episode."""
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(featured)
    return scored.withColumn("boundary", vector_to_array("probability")[1]).drop("_f", "rawPrediction", "probability", "prediction")
