"""Vector arithmetic on ``array<float>`` columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _doubles(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("array<double>")


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(_doubles(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a, b) -> Column:
    """Cosine similarity; 0 when a norm is below 1e-9 or the lengths differ; null for a null vector."""
    a, b = _doubles(a), _doubles(b)
    na, nb = norm(a), norm(b)
    return F.when(a.isNull() | b.isNull(), None).when((na < 1e-9) | (nb < 1e-9) | (F.size(a) != F.size(b)), 0.0).otherwise(dot(a, b) / (na * nb))


def dual_cosine(v, centroid, first_centroid) -> Column:
    """Best of the similarities to a moving and to the first centroid, not below 0."""
    return F.greatest(cosine(v, centroid), cosine(v, first_centroid), F.lit(0.0))


def mean_vector(vec: str, dimension: int) -> Column:
    """Aggregate: the mean of fixed-length vectors. One average per position, so it combines before the shuffle."""
    return F.array(*[F.avg(F.col(vec)[i].cast("double")) for i in range(dimension)])


def weighted_mean_vector(vec: str, weight: str, dimension: int) -> Column:
    """Aggregate: size-weighted centroid of centroids."""
    w = F.col(weight).cast("double")
    return F.array(*[F.sum(F.col(vec)[i].cast("double") * w) / F.sum(w) for i in range(dimension)])


def scale(a, factor: float) -> Column:
    return F.transform(_doubles(a), lambda x: x * factor)


def ema_step(old, new, weight_of_new: float) -> Column:
    """One step of an exponential moving average; the first value initialises it."""
    old, new = _doubles(old), _doubles(new)
    return F.when(old.isNull(), new).otherwise(F.zip_with(old, new, lambda x, y: x * (1 - weight_of_new) + y * weight_of_new))


def ema_vector(ordered, weight_of_new: float) -> Column:
    """Moving average of an ordered array of vectors."""
    rest = F.slice(ordered, F.lit(2), F.greatest(F.size(ordered) - 1, F.lit(0)))
    return F.aggregate(rest, _doubles(F.element_at(ordered, 1)), lambda c, x: F.zip_with(c, x.cast("array<double>"), lambda p, q: p * (1 - weight_of_new) + q * weight_of_new))


def hashing_embedding(text, dimension: int = 64) -> Column:
    """Deterministic stand-in for a text model: signed hashed bag of words, of unit length (zero for no words)."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    at = F.transform(words, lambda w: F.struct(F.pmod(F.xxhash64(w), F.lit(dimension)).cast("int").alias("i"), F.when(F.pmod(F.hash(w), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("s")))
    raw = F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.aggregate(F.filter(at, lambda x: x["i"] == i), F.lit(0.0), lambda acc, x: acc + x["s"]))
    length = norm(raw)
    return F.when(length < 1e-9, raw).otherwise(F.transform(raw, lambda x: x / length))


def is_usable(vec: str, dimension: int) -> Column:
    v = _doubles(vec)
    return v.isNotNull() & (F.size(v) == dimension) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)


def centroids(df: DataFrame, group: str, vec: str, dimension: int) -> DataFrame:
    return df.where(is_usable(vec, dimension)).groupBy(group).agg(mean_vector(vec, dimension).alias("centroid"), F.count(F.lit(1)).alias("n"))
