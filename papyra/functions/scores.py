"""Scores, bands and classes of the reference as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def confidence_band(c: Column) -> Column:
    """PRJ-05."""
    return F.when(c >= 0.7, "high").when(c >= 0.4, "medium").otherwise("low")


def trend_score(growth: Column, rate: Column, velocity: Column, acceleration: Column, count: Column) -> Column:
    """WN-08."""
    total = (
        0.3 * F.least(growth / 10, F.lit(10.0)) + 0.25 * F.least(rate / 50, F.lit(5.0)) + 0.25 * F.least(velocity * 10, F.lit(5.0))
        + 0.2 * F.least(acceleration * 100, F.lit(3.0)) + F.least(F.log(count + 1.0) / 5, F.lit(2.0))
    )
    return F.greatest(total, F.lit(0.0))


def trend_class(rate: Column, velocity: Column, acceleration: Column) -> Column:
    """WN-09: the first rule that holds."""
    return (
        F.when(acceleration > 0.5, "burst").when((rate > 20) & (velocity > 0.1), "rising").when((rate < -10) | (velocity < -0.05), "declining")
        .when((F.abs(rate) < 5) & (F.abs(velocity) < 0.02), "stable").otherwise("fluctuating")
    )


def trend_confidence(points: Column, mean_gap: Column, window_days: int) -> Column:
    """WN-07."""
    c = F.lit(0.5) + F.when(points >= 5, 0.2).when(points >= 3, 0.1).otherwise(0.0) + F.when(mean_gap <= 7, 0.2).when(mean_gap <= 30, 0.1).otherwise(0.0)
    return F.least(c + (0.1 if window_days >= 90 else 0.0), F.lit(1.0))


def rag_confidence(mean_score: Column, citations: Column, answer_length: Column) -> Column:
    """AG-25."""
    return 0.4 * mean_score + 0.3 * F.least(citations / 3, F.lit(1.0)) + 0.3 * F.least(answer_length / 500, F.lit(1.0))


def qa_confidence(mean_score: Column, citations: Column, deviation: Column) -> Column:
    """AG-26 (population deviation)."""
    return F.least(mean_score * F.least(citations / 3, F.lit(1.0)) * F.greatest(F.lit(0.5), 1 - deviation), F.lit(1.0))


def summary_confidence(chunks: Column, summary_words: Column, source_words: Column) -> Column:
    """AG-27: coverage (chunks, up to 10) and coherence (share of words kept, best at a tenth)."""
    return F.least(0.5 * F.least(chunks / 10, F.lit(1.0)) + 0.5 * F.least(F.coalesce(F.try_divide(summary_words * 10, source_words), F.lit(0.0)), F.lit(1.0)), F.lit(1.0))


def impact(cited_by: Column, cites: Column, similar: Column, together: Column) -> Column:
    """AG-18."""
    return 2.0 * cited_by + cites + 0.5 * similar + 0.3 * together


def alert_level(value: Column, warning: float, critical: float) -> Column:
    """SF-39."""
    return F.when(value >= critical, "critical").when(value >= warning, "warning").otherwise("ok")


def health_class(free_share: Column, fail: float, warn: float) -> Column:
    """SF-40: of a free share in percent."""
    return F.when(free_share < fail, "unhealthy").when(free_share < warn, "degraded").otherwise("healthy")


def present_weighted(*parts: tuple[Column, float]) -> Column:
    """SF-19: mean of the scores that aren't null, by weight, renormalised; null if none is there."""
    score = sum((F.coalesce(c * w, F.lit(0.0)) for c, w in parts), F.lit(0.0))
    weight = sum((F.when(c.isNotNull(), w).otherwise(0.0) for c, w in parts), F.lit(0.0))
    return F.try_divide(score, weight)


def distance_to_similarity(d: Column, metric: str) -> Column:
    """SF-37; cosine and inner product are similarities already."""
    return 1 / (1 + d) if metric == "l2" else d
