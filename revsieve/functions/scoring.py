"""Scores, confidence buckets, feedback multipliers and finding ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from revsieve.functions.text import any_of

# Ranking weights; anything else weighs 1.
CATEGORY_WEIGHTS = {
    "security": 10.0,
    "bug": 8.0,
    "business_logic": 7.0,
    "architecture": 6.0,
    "performance": 5.0,
    "test": 4.0,
    "code_quality": 3.0,
    "style": 1.0,
}
PRIORITY_WEIGHTS = {"critical": 10.0, "high": 7.0, "medium": 4.0, "low": 2.0, "info": 1.0}
CRITICAL_PATH_WORDS = (
    "auth", "payment", "security", "encrypt", "secret", "admin", "permission", "access",
)
CRITICAL_BOOST = 1.5
SECURITY_BOOST = 1.2
CONFIDENCE_LEVELS = (("very_high", 0.9), ("high", 0.7), ("medium", 0.5), ("low", 0.3))
FEEDBACK_MULTIPLIERS = {
    "positive": 1.1, "negative": 0.9, "neutral": 1.0, "correction": 0.95, "ignored": 0.85,
}


def weight_of(col: Column, weights: dict[str, float]) -> Column:
    pairs = [F.lit(x) for kv in weights.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), col), F.lit(1.0))


def is_critical_file(path: Column) -> Column:
    return any_of(F.lower(path), CRITICAL_PATH_WORDS)


def priority_score(category: Column, priority: Column, confidence: Column, path: Column) -> Column:
    base = weight_of(category, CATEGORY_WEIGHTS) * weight_of(priority, PRIORITY_WEIGHTS) * confidence
    boosted = F.when(is_critical_file(path), base * CRITICAL_BOOST).otherwise(base)
    return F.when(category == "security", boosted * SECURITY_BOOST).otherwise(boosted)


def confidence_level(confidence: Column) -> Column:
    level = F.lit("very_low")
    for name, floor in reversed(CONFIDENCE_LEVELS):
        level = F.when(confidence >= floor, name).otherwise(level)
    return level


def finding_id(category: Column, path: Column, line: Column, title_md5: Column) -> Column:
    """Stable id; the title enters as its md5 so that equal findings agree across runs."""
    return F.concat_ws("_", category, path, line.cast("string"), title_md5)


def feedback_multiplier(feedback_type: Column, count: Column) -> Column:
    kind = F.lower(feedback_type)
    base = weight_of(kind, FEEDBACK_MULTIPLIERS)
    step = F.least(count / F.lit(10.0), F.lit(0.2))
    return (
        F.when(kind == "positive", base + step)
        .when(kind == "negative", base - step)
        .otherwise(base)
    )


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def adjusted_confidence(
    confidence: Column, total: Column, positive_ratio: Column, multiplier: Column | float = 1.0
) -> Column:
    """Confidence moved by up to a tenth towards what reviewers said about the finding."""
    multiplier = multiplier if isinstance(multiplier, Column) else F.lit(float(multiplier))
    shifted = confidence * multiplier + (positive_ratio - 0.5) * 0.2
    return F.when(F.coalesce(total, F.lit(0)) == 0, confidence).otherwise(clamp(shifted, 0.0, 1.0))
