"""Scalar scores of episodic memory: decay, recency, retention, attachment."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def temporal_decay(gap_minutes: Column, threshold: float = 120.0) -> Column:
    return F.exp(-(2.3 / threshold) * F.abs(gap_minutes))


def half_life_recency(hours: Column, half_life: float = 168.0) -> Column:
    return F.pow(F.lit(2.0), -F.greatest(hours, F.lit(0.0)) / half_life)


def monthly_recency(days: Column) -> Column:
    return F.exp(-F.greatest(days, F.lit(0.0)) / 30.0)


def retention(days: Column, salience: Column, access_count: Column, base: float = 0.1) -> Column:
    """Forgetting curve: slower for salient and for often recalled episodes."""
    return F.exp(-(base / (1 + salience)) * days / (1 + F.log1p(access_count)))


def age_penalty(idle_hours: Column, state: Column, active_hours: float = 24.0) -> Column:
    """Dormant episodes age from the start, active ones after a day; archived ones not at all."""
    h = F.greatest(idle_hours, F.lit(0.0))
    return F.when(state == "DORMANT", F.log1p(h)).when(state == "ARCHIVED", 0.0).when(h > active_hours, 0.3 * F.log1p(h - active_hours)).otherwise(0.0)


def attach_score(sem: Column, ent: Column, temp: Column, goal: Column, age: Column, w=(0.55, 0.15, 0.10, 0.20, 0.05)) -> Column:
    return F.greatest(F.lit(0.0), w[0] * sem + w[1] * ent + w[2] * temp + w[3] * goal - w[4] * age)


def urgency(age_days: Column, threshold: float, importance: Column) -> Column:
    return F.round(F.least(F.lit(1.0), age_days / max(threshold, 1.0) * (1 - 0.4 * importance)), 4)


def softmax(values: Column) -> Column:
    top = F.array_max(values)
    e = F.transform(values, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def axis_scores(goal_vector: Column) -> Column:
    """Largest score of each of three groups of three goals."""
    return F.struct(*[F.array_max(F.slice(goal_vector, 1 + 3 * i, 3)).alias(n) for i, n in enumerate(("resolution", "salience", "temporality"))])


def creation_threshold(attach: float, novelty: float, n_active: Column) -> Column:
    return F.lit(attach) - novelty * F.least(n_active / 15.0, F.lit(1.0))


def hybrid_threshold(threshold: Column, boundary_prob: Column, k: float = 0.3) -> Column:
    return threshold + k * (1 - boundary_prob)


def gap_log(minutes: Column) -> Column:
    """Scaled log of a gap; 1.0 for the first of a sequence (null gap)."""
    import math

    return F.coalesce(F.log1p(minutes) / math.log1p(1440.0), F.lit(1.0))


def length_log(text: Column) -> Column:
    import math

    return F.log1p(F.length(text)) / math.log1p(500.0)


def focal_loss(p: Column, y: Column, gamma: float = 2.0) -> Column:
    q = F.when(y == 1, p).otherwise(1 - p)
    return -F.pow(1 - q, gamma) * F.log(F.greatest(q, F.lit(1e-8)))
