"""Team conventions: load, default, attach and extend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revsieve.schemas import TEAM_CONTEXT

# Conventions of a team that has not written its own.
DEFAULT_CONVENTIONS = {
    "naming": {
        "functions": "snake_case",
        "classes": "PascalCase",
        "constants": "UPPER_SNAKE_CASE",
    },
    "max_line_length": 100,
    "docstring_style": "google",
}
DEFAULT_PATTERNS = {
    "known_patterns": (
        "Use dependency injection for services",
        "Always validate user input",
        "Use async/await for I/O operations",
    ),
    "anti_patterns": (
        "Avoid global state",
        "Don't use mutable default arguments",
        "Avoid deep nesting (>3 levels)",
    ),
    "recent_refactors": (),
    "team_members": (),
}


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def default_conventions() -> Column:
    naming = F.struct(*[F.lit(v).alias(k) for k, v in DEFAULT_CONVENTIONS["naming"].items()])
    return F.struct(
        naming.alias("naming"),
        F.lit(DEFAULT_CONVENTIONS["max_line_length"]).alias("max_line_length"),
        F.lit(DEFAULT_CONVENTIONS["docstring_style"]).alias("docstring_style"),
    )


def defaults(spark: SparkSession, team_name: str | None = None) -> DataFrame:
    return spark.range(1).select(
        F.lit(team_name).cast("string").alias("team_name"),
        default_conventions().alias("coding_conventions"),
        *[_strings(v).alias(k) for k, v in DEFAULT_PATTERNS.items()],
    )


def load(spark: SparkSession, path: str, team_name: str | None = None) -> DataFrame:
    """Conventions file as one row; a missing or unreadable file gives the defaults.

    Parts the file leaves out are empty, as in a file that was written on purpose.
    """
    fields = TEAM_CONTEXT.split(" ", 2)[2]
    try:
        rows = (
            spark.read.schema(f"{fields}, _corrupt_record string")
            .option("multiLine", True).json(path)
        )
        first = rows.limit(1).cache()
        usable = first.filter(F.col("_corrupt_record").isNull()).count() == 1
        first.unpersist()
    except Exception as err:  # a missing path is an analysis error
        if "PATH_NOT_FOUND" not in str(err):
            raise
        usable = False
    if not usable:
        return defaults(spark, team_name)
    return rows.limit(1).select(
        F.lit(team_name).cast("string").alias("team_name"),
        "coding_conventions",
        *[F.coalesce(k, _strings(())).alias(k) for k in DEFAULT_PATTERNS],
    )


def attach(prs: DataFrame, contexts: DataFrame, team_col: str = "team_name") -> DataFrame:
    """Each pull request with its team's context, or the default one."""
    filled = prs.join(contexts, team_col, "left")
    out = filled.withColumn(
        "coding_conventions", F.coalesce("coding_conventions", default_conventions())
    )
    for k, v in DEFAULT_PATTERNS.items():
        out = out.withColumn(k, F.coalesce(k, _strings(v)))
    return out


def add_pattern(contexts: DataFrame, pattern: str, kind: str = "known_patterns") -> DataFrame:
    """Append a pattern unless the list has it."""
    return contexts.withColumn(
        kind,
        F.array_union(F.coalesce(F.col(kind), _strings(())), F.array(F.lit(pattern))),
    )


def save(contexts: DataFrame, path: str) -> None:
    contexts.write.mode("overwrite").json(path)
