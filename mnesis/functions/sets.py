"""Entity sets and weights: overlaps on arrays and maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tidy_entities(entities: Column) -> Column:
    """Lower-cased, trimmed, distinct, without blanks; empty for null."""
    clean = F.transform(F.coalesce(entities, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x)))
    return F.array_distinct(F.filter(clean, lambda x: x.isNotNull() & (x != "")))


def jaccard(a: Column, b: Column) -> Column:
    """Plain Jaccard of two arrays; 0 when both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def _total(m: Column) -> Column:
    return F.aggregate(F.map_values(m), F.lit(0.0), lambda s, x: s + x)


def weighted_jaccard(a: Column, b: Column) -> Column:
    """Shared weight of both maps over all weight of both."""
    shared = F.array_intersect(F.map_keys(a), F.map_keys(b))
    both = F.aggregate(shared, F.lit(0.0), lambda s, k: s + F.element_at(a, k) + F.element_at(b, k))
    total = _total(a) + _total(b)
    return F.when(total <= 0, 0.0).otherwise(both / total)


def precision_overlap(entities: Column, weights: Column) -> Column:
    """Weight of an artifact's entities in an episode, over their number and the episode's largest weight."""
    shared = F.array_intersect(entities, F.map_keys(weights))
    got = F.aggregate(shared, F.lit(0.0), lambda s, k: s + F.element_at(weights, k))
    top = F.array_max(F.map_values(weights))
    return F.when((F.size(entities) == 0) | (F.coalesce(top, F.lit(0.0)) <= 0), 0.0).otherwise(got / (F.size(entities) * top))


def query_entity_score(query: Column, weights: Column) -> Column:
    shared = F.array_intersect(query, F.map_keys(weights))
    total = _total(weights)
    return F.when(total <= 0, 0.0).otherwise(F.aggregate(shared, F.lit(0.0), lambda s, k: s + F.element_at(weights, k)) / total)


def matches_query(entity: Column, query: Column) -> Column:
    """An entity contained in the query text, or a query word of three letters or more contained in it."""
    words = F.filter(F.split(F.lower(query), r"\s+"), lambda w: F.length(w) > 2)
    return F.contains(F.lower(query), F.lower(entity)) | F.exists(words, lambda w: F.contains(F.lower(entity), w))


def top_keys(weights: Column, n: int) -> Column:
    """Keys of the largest weights; ties in alphabetical order."""
    entries = F.array_sort(F.transform(F.map_entries(weights), lambda e: F.struct((-e["value"]).alias("w"), e["key"].alias("k"))))
    return F.transform(F.slice(entries, 1, n), lambda e: e["k"])


def merge_weights_sum(a: Column, b: Column) -> Column:
    return F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0)))


def merge_weights_scaled(a: Column, b: Column, n_a: Column, n_b: Column) -> Column:
    """The larger weight of shared entities; others scaled by their side's share of the members."""
    total = n_a + n_b
    return F.map_zip_with(a, b, lambda k, x, y: F.when(x.isNotNull() & y.isNotNull(), F.greatest(x, y)).when(y.isNull(), x).otherwise(y * n_b / total))
