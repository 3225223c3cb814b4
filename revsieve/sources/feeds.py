"""Feeds of arriving JSON: rows that pass their checks, and the others with the reason, in one pass.

``checked_feedback`` and ``checked_events`` are projections, so they take tables and streams. ``split_table`` and ``split_stream`` write both kinds
of rows at once, under ``accepted=true`` and ``accepted=false``; ``accepted`` and ``rejected`` read them back.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revsieve.schemas import FEEDBACK, FEEDBACK_SOURCES, FEEDBACK_TYPES
from revsieve.streaming.events import route

#: Fields that manual feedback can't do without.
REQUIRED = ("analysis_result_id", "pr_id", "pr_number", "repo_owner", "repo_name", "feedback_type", "source", "reviewer",
            "category", "file_path", "line_number")


def first_reason(checks: list[tuple[Column, Column | str]]) -> Column:
    """The reason of the first check whose condition holds; null if none does."""
    typed = [(c, F.lit(r) if isinstance(r, str) else r) for c, r in checks]
    return reduce(lambda found, check: F.when(F.coalesce(check[0], F.lit(False)), check[1]).otherwise(found), reversed(typed), F.lit(None).cast("string"))


def checked_feedback(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines of JSON as feedback: its fields, the line itself as ``raw``, and ``reason`` (null if the line is accepted).

    Each line is parsed once; only those that do not parse cleanly are looked at again for the reason.
    """
    raw, p = F.col(f"`{column}`"), F.col("_p")
    parsed = lines.withColumn("_p", F.from_json(raw, f"{FEEDBACK}, _broken string", {"columnNameOfCorruptRecord": "_broken"}))
    unclean = p.isNull() | p["_broken"].isNotNull()

    def missing(name: str) -> list[tuple[Column, Column | str]]:
        empty = p[name].isNull() | (p[name].cast("string") == "")
        given = F.get_json_object(raw, f"$.{name}").isNotNull()
        return [(empty & unclean & given, f"Wrong type of {name}"), (empty, f"Missing {name}")]

    def unknown(name: str, known: tuple[str, ...]) -> tuple[Column, Column]:
        return ~p[name].isin(*known), F.concat(F.lit(f"Unknown {name} '"), p[name], F.lit("'"))

    reason = first_reason([
        (raw.isNull() | raw.rlike(r"^\s*$"), "Empty line"),
        (unclean & F.try_parse_json(raw).isNull(), "Invalid JSON"),
        (unclean & ~raw.rlike(r"^\s*\{"), "Not an object"),
        *(check for name in REQUIRED for check in missing(name)),
        unknown("feedback_type", FEEDBACK_TYPES),
        unknown("source", FEEDBACK_SOURCES),
        (p["line_number"] < 0, "Negative line_number"),
        (unclean, "Wrong type of an optional field"),
    ])
    names = [f.strip().split(" ")[0] for f in FEEDBACK.replace("map<string,string>", "map").split(",")]
    kept = [F.col(f"`{c}`") for c in lines.columns if c not in (column, "raw", "reason", *names)]
    return parsed.select(*kept, *(p[n].alias(n) for n in names), raw.alias("raw"), reason.alias("reason"))


def checked_events(events: DataFrame) -> DataFrame:
    """Host events, routed; ``reason`` says why one is an error, and is null for all others."""
    routed = route(events)
    return routed.withColumn("reason", F.when(F.col("status") == "error", F.col("reason")))


def _marked(checked: DataFrame) -> DataFrame:
    return checked.withColumn("accepted", F.col("reason").isNull())


def split_table(checked: DataFrame, folder: str, mode: str = "append") -> None:
    _marked(checked).write.mode(mode).partitionBy("accepted").parquet(folder)


def split_stream(checked: DataFrame, folder: str, checkpoint: str, available_now: bool = True):
    """The same for a stream, each row exactly once."""
    writer = _marked(checked).writeStream.format("parquet").outputMode("append").partitionBy("accepted").option(
        "path", folder).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _read(spark: SparkSession, folder: str, schema, good: bool) -> DataFrame:
    rows = spark.read.schema(f"{schema}, accepted boolean").parquet(folder)
    return rows.where(F.col("accepted") == good).drop("accepted")


def accepted(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Rows that passed; ``schema`` is that of the checked rows. Reads nothing of the others."""
    return _read(spark, folder, schema, True).drop("reason")


def rejected(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Rows that did not pass, each with its reason."""
    return _read(spark, folder, schema, False)
