"""Readers: raw exports of the code host to the review tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revsieve import schemas
from revsieve.functions.languages import detect_language
from revsieve.functions.text import pr_key

SCHEMAS = {
    "prs": schemas.PRS,
    "file_diffs": schemas.FILE_DIFFS,
    "commit_files": schemas.COMMIT_FILES,
    "issues": schemas.ISSUES,
    "repos": schemas.REPOS,
    "feedback": schemas.FEEDBACK,
    "learning_patterns": schemas.LEARNING_PATTERNS,
    "rules": schemas.RULES,
}


def read_table(spark: SparkSession, path: str, name: str, fmt: str = "parquet") -> DataFrame:
    """A stored review table with its declared schema, so nothing is inferred."""
    return spark.read.format(fmt).schema(SCHEMAS[name]).load(path)


def stream_table(spark: SparkSession, path: str, name: str, fmt: str = "json", **options) -> DataFrame:
    """The same table as a stream of arriving files."""
    reader = spark.readStream.format(fmt).schema(SCHEMAS[name])
    return reader.options(**options).load(path)


def pr_headers(raw: DataFrame) -> DataFrame:
    """Host pull requests: labels are objects with a name, ids are built from the repository."""
    return raw.withColumns({
        "pr_id": pr_key(F.col("repo_owner"), F.col("repo_name"), F.col("number")),
        "pr_number": F.col("number"),
        "description": F.col("body"),
        "labels": F.transform("labels", lambda l: l["name"]),
        "state": F.coalesce("state", F.lit("open")),
    }).drop("number", "body")


def file_diffs(raw: DataFrame) -> DataFrame:
    """Changed files: a missing patch is an empty text, the language comes from the name."""
    return raw.select(
        "pr_id", "file_ord", F.col("filename").alias("file_path"),
        "additions", "deletions", "changes",
        F.coalesce("patch", F.lit("")).alias("diff"), "status",
        detect_language(F.col("filename")).alias("language"),
    )


def repositories(raw: DataFrame) -> DataFrame:
    empty = F.create_map().cast("map<string,bigint>")
    return raw.withColumns({
        "full_name": F.coalesce("full_name", F.concat_ws("/", "owner", "name")),
        "languages": F.coalesce("languages", empty),
    })


def parse_payload(raw: Column, broken: str | None = None) -> Column:
    """A payload's fields; with ``broken`` there is a field of that name, which holds a text that did not parse cleanly."""
    if broken is None:
        return F.from_json(raw, schemas.WEBHOOK_PAYLOAD)
    return F.from_json(raw, f"{schemas.WEBHOOK_PAYLOAD}, {broken} string", {"columnNameOfCorruptRecord": broken})
