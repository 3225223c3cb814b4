"""Windowed counters over feedback and reviews, for streams and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revsieve.schemas import FEEDBACK_TYPES

RETENTION = "30 days"  # Fixed value: counters live this long after the last write.


def timed(df: DataFrame, column: str = "ts", delay: str | None = None) -> DataFrame:
    """Event time as an instant (watermarks need one), with an optional watermark."""
    out = df.withColumn(column, F.col(column).cast("timestamp"))
    return out.withWatermark(column, delay) if delay else out


def drop_repeats(df: DataFrame, key: str = "id", delay: str = RETENTION) -> DataFrame:
    """First arrival per id within the delay; state expires with the watermark."""
    if df.isStreaming:
        return timed(df, delay=delay).dropDuplicatesWithinWatermark([key])
    return df.dropDuplicates([key])


def sessions(feedback: DataFrame, gap: str = RETENTION, delay: str | None = None) -> DataFrame:
    """Counters per finding that end after ``gap`` without feedback.

    Each write renews a counter, so its life is a session: a run of feedback without
    a gap of that length. Rows are merged inside each task before the shuffle, so a
    finding with very many rows sends one row per task and session.
    """
    feedback.sparkSession.conf.set(
        "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true"
    )
    counts = [
        F.count_if(F.col("feedback_type") == kind).alias(f"{kind}_count")
        for kind in FEEDBACK_TYPES[:4]
    ]
    return (
        timed(feedback, delay=delay)
        .groupBy("analysis_result_id", F.session_window("ts", gap).alias("w"))
        .agg(F.count("*").alias("total_count"), *counts)
        .select("analysis_result_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"),
                "total_count", *[f"{k}_count" for k in FEEDBACK_TYPES[:4]])
    )


def sliding_counts(feedback: DataFrame, size: str = RETENTION, slide: str = "1 day",
                   delay: str | None = None) -> DataFrame:
    """(category, type) counts of the last ``size``, moved on every ``slide``.

    Rows are first counted per slide, so only those counts are copied into the many
    windows they belong to.
    """
    per_slide = (
        timed(feedback, delay=delay)
        .groupBy(F.window("ts", slide).alias("w"), "category", "feedback_type")
        .agg(F.count("*").alias("n"))
        .select(F.window_time("w").alias("at"), "category", "feedback_type", "n")
    )
    return (
        per_slide.groupBy(F.window("at", size, slide).alias("w"), "category", "feedback_type")
        .agg(F.sum("n").alias("feedback_count"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"),
                "category", "feedback_type", "feedback_count")
    )


def per_day(events: DataFrame, delay: str | None = None) -> DataFrame:
    return (
        timed(events, delay=delay)
        .groupBy(F.window("ts", "1 day").alias("w"))
        .agg(F.count("*").alias("reviews"))
        .select(F.col("w.start").alias("day"), "reviews")
    )
