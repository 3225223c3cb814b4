"""Filter, dedupe and rank findings per pull request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revsieve.operators.catalog import RuleBook

MIN_CONFIDENCE = 0.6  # Fixed value: default final threshold.
MAX_RESULTS = 50  # Fixed value: default findings kept per pull request.


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int, name: str) -> DataFrame:
    """First ``n`` rows of every key, numbered from 1.

    ``row_number() <= n`` lets Spark apply a window group limit on both sides of
    the shuffle: a task sends at most ``n`` rows per key, however hot the key.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)


def score_findings(findings: DataFrame, book: RuleBook, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    return findings.filter(F.col("confidence") >= min_confidence).withColumn("score", book.score())


def hashed(df: DataFrame, *keys: str) -> DataFrame:
    """With a number for the keys in ``_key``: put before them, it settles nearly all comparisons of a sort, and long texts are seldom compared."""
    return df.withColumn("_key", F.xxhash64(*keys))


def dedupe_findings(scored: DataFrame, book: RuleBook) -> DataFrame:
    """Best finding of each (pull request, file, line, category, title start)."""
    keyed = scored.withColumn("_sig", book.signature())
    order = [F.col("score").desc(), *book.emission_order()]
    keys = ["pr_id", "file_path", "line_start", "_sig"]
    return top_per_key(hashed(keyed, *keys), ["_key", *keys], order, 1, "_rn").drop("_key", "_sig", "_rn")


def rank_findings(
    findings: DataFrame,
    book: RuleBook,
    min_confidence: float = MIN_CONFIDENCE,
    max_results: int = MAX_RESULTS,
) -> DataFrame:
    scored = score_findings(findings, book, min_confidence)
    order = [F.col("score").desc(), *book.emission_order()]
    kept = hashed(dedupe_findings(scored, book), "pr_id")
    return top_per_key(kept, ["_key", "pr_id"], order, max_results, "rank").drop("_key")
