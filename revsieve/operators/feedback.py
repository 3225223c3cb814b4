"""Feedback: collection, statistics, learned patterns and confidence changes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revsieve.functions import feedback_text as ft
from revsieve.functions import scoring
from revsieve.plans.joins import fits, join_small
from revsieve.plans.lineage import cut

# Learning thresholds.
MIN_PATTERN_COUNT = 3
MIN_CATEGORY_TOTAL = 5
CATEGORY_STEP, CATEGORY_LOW, CATEGORY_HIGH = 0.3, 0.7, 1.3
FALSE_POSITIVE_MULTIPLIER, FALSE_NEGATIVE_MULTIPLIER = 0.7, 1.2
LOOK_BACK_DAYS = 30


def from_reactions(reactions: DataFrame) -> DataFrame:
    return reactions.select(
        *[c for c in reactions.columns if c not in ("reaction",)],
        "reaction",
        ft.reaction_type(F.col("reaction")).alias("feedback_type"),
        F.lit("github_reaction").alias("source"),
        F.create_map(F.lit("reaction"), F.col("reaction")).alias("metadata"),
    )


def from_replies(replies: DataFrame, whole_words: bool = False) -> DataFrame:
    kind = ft.reply_type(F.col("reply_text"), whole_words)
    return (
        replies.withColumn("feedback_type", kind)
        .withColumns({
            "source": F.lit("comment_reply"),
            "comment": F.col("reply_text"),
            "correction": ft.reply_correction(F.col("reply_text"), F.col("feedback_type")),
        })
    )


def from_fixes(findings: DataFrame) -> DataFrame:
    """Rows with ``was_fixed`` as automatic feedback."""
    return findings.withColumns({
        "feedback_type": ft.fixed_type(F.col("was_fixed")),
        "source": F.lit("auto_detected"),
        "reviewer": F.lit("system"),
        "metadata": F.create_map(
            F.lit("auto_detected"), F.lit("true"),
            F.lit("was_fixed"), F.col("was_fixed").cast("string"),
        ),
    })


def mark_fixed(earlier: DataFrame, later: DataFrame) -> DataFrame:
    """Findings of an earlier version, fixed if the later version no longer has them."""
    keys = ["pr_id", "analysis_result_id"]
    still = later.select(*keys).distinct().withColumn("_still", F.lit(True))
    return (
        earlier.join(still, keys, "left")
        .withColumn("was_fixed", F.col("_still").isNull())
        .drop("_still")
    )


def store(feedback: DataFrame, prs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row per feedback id (newest wins) and its links to known pull requests."""
    keyed = feedback.withColumn(
        "id",
        F.coalesce(
            "id",
            F.concat_ws("_", "pr_id", "analysis_result_id", F.unix_micros(F.col("ts").cast("timestamp")).cast("string")),
        ),
    )
    w = Window.partitionBy("id").orderBy(F.col("ts").desc(), "reviewer", "feedback_type")
    rows = keyed.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
    links = rows.join(prs.select("pr_id"), "pr_id", "left_semi").select(
        "id", "pr_id", "analysis_result_id"
    )
    return rows, links


def stats(feedback: DataFrame) -> DataFrame:
    """Counters per finding; ``ignored`` counts in the total only."""

    def n(kind: str) -> Column:
        return F.count_if(F.col("feedback_type") == kind)

    return feedback.groupBy("analysis_result_id").agg(
        F.count("*").alias("total_feedback"),
        n("positive").alias("positive_count"),
        n("negative").alias("negative_count"),
        n("neutral").alias("neutral_count"),
        n("correction").alias("correction_count"),
        (n("positive") / F.count("*")).alias("positive_ratio"),
    )


def newest_first(feedback: DataFrame, bucket: str = "hour") -> DataFrame:
    """Feedback of a finding numbered from the newest, without one task per finding.

    Rows are ranked inside (finding, time bucket) and shifted by the number of rows
    in later buckets, so a finding with very many rows is spread over its buckets.
    """
    keyed = feedback.withColumn("_bucket", F.date_trunc(bucket, "ts"))
    key = ["analysis_result_id", "_bucket"]
    later = Window.partitionBy("analysis_result_id").orderBy(F.col("_bucket").desc()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    shift = keyed.groupBy(*key).count().select(
        *key, F.coalesce(F.sum("count").over(later), F.lit(0)).alias("_shift")
    )
    local = Window.partitionBy(*key).orderBy(F.col("ts").desc(), F.col("id").desc())
    return (
        keyed.withColumn("_local", F.row_number().over(local))
        .join(shift, key)
        .withColumn("position", (F.col("_local") + F.col("_shift")).cast("long"))
        .drop("_local", "_shift", "_bucket")
    )


def patterns(feedback: DataFrame, as_of: Column, days: int = LOOK_BACK_DAYS) -> DataFrame:
    """(category, type) groups with enough recent feedback, as learned patterns."""
    recent = feedback.filter(
        (F.col("ts") > as_of - F.make_dt_interval(F.lit(days))) & (F.col("ts") <= as_of))
    grouped = (
        recent.groupBy("category", "feedback_type")
        .agg(F.count("*").alias("feedback_count"))
        .filter(F.col("feedback_count") >= MIN_PATTERN_COUNT)
    )
    return grouped.select(
        F.concat_ws("_", "category", "feedback_type").alias("pattern_id"),
        F.lit("category_feedback").alias("pattern_type"),
        "category",
        "feedback_type",
        F.concat("feedback_type", F.lit(" feedback for "), "category", F.lit(" category")).alias(
            "pattern_description"
        ),
        "feedback_count",
        scoring.feedback_multiplier(F.col("feedback_type"), F.col("feedback_count")).alias(
            "confidence_multiplier"
        ),
    ).orderBy(F.col("feedback_count").desc(), "pattern_id")


def category_adjustments(feedback: DataFrame) -> DataFrame:
    share = lambda kind: F.count_if(F.col("feedback_type") == kind) / F.count("*")
    grouped = feedback.groupBy("category").agg(
        F.count("*").alias("total"),
        share("positive").alias("positive_ratio"),
        share("negative").alias("negative_ratio"),
    )
    raw = 1.0 + (F.col("positive_ratio") - F.col("negative_ratio")) * CATEGORY_STEP
    return grouped.filter(F.col("total") >= MIN_CATEGORY_TOTAL).select(
        "category", "positive_ratio", "negative_ratio",
        scoring.clamp(raw, CATEGORY_LOW, CATEGORY_HIGH).alias("multiplier"),
    )


def _directory(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_extract(path, "^(.*/)", 1)).otherwise("")


def learned_rows(feedback: DataFrame, kind: str, min_count: int = MIN_CATEGORY_TOTAL,
                 min_share: float = 0.5, counted: str | None = None) -> DataFrame:
    """False-positive or false-negative patterns per category and directory.

    A directory whose feedback is mostly negative (false positives) or mostly
    corrections (false negatives) becomes a row of ``learning_patterns``; another
    feedback type can be named in ``counted``.
    """
    wanted, prefix, multiplier = {
        "false_positive": ("negative", "fp", FALSE_POSITIVE_MULTIPLIER),
        "false_negative": ("correction", "fn", FALSE_NEGATIVE_MULTIPLIER),
    }[kind]
    wanted = counted or wanted
    share = F.count_if(F.col("feedback_type") == wanted) / F.count("*")
    grouped = (
        feedback.groupBy("category", _directory(F.col("file_path")).alias("directory"))
        .agg(F.count("*").alias("feedback_count"), share.alias("share"))
        .filter((F.col("feedback_count") >= min_count) & (F.col("share") >= min_share))
    )
    escaped = F.regexp_replace("directory", r"([\\.^$|?*+()\[\]{}])", r"\\$1")
    label = kind.replace("_", " ").capitalize()
    return grouped.select(
        F.concat_ws("_", F.lit(prefix), "category", F.md5("directory")).alias("pattern_id"),
        F.lit(kind).alias("pattern_type"),
        "category",
        F.concat(F.lit(f"{label} pattern for "), "category").alias("pattern_description"),
        F.concat(F.lit("^"), escaped).alias("file_pattern"),
        F.lit(None).cast("string").alias("code_pattern"),
        "feedback_count",
        F.lit(multiplier).alias("confidence_multiplier"),
        F.lit(None).cast("double").alias("conf_min"),
        F.lit(None).cast("double").alias("conf_max"),
        F.lit(True).alias("should_apply"),
    )


def adjust_findings(findings: DataFrame, stats_df: DataFrame, id_col: Column,
                    multiplier: Column | float = 1.0) -> DataFrame:
    """Left join of the counters, then the confidence each finding now has.

    The findings side may hold very many rows of one id; it stays the splittable
    (streamed) side of the join, so adaptive execution can split that partition.
    """
    slim = stats_df.select(
        F.col("analysis_result_id").alias("_fid"), "total_feedback", "positive_ratio"
    )
    joined = findings.withColumn("_id", id_col).join(slim, F.col("_id") == F.col("_fid"), "left")
    return joined.withColumn(
        "confidence",
        scoring.adjusted_confidence(
            F.col("confidence"), F.col("total_feedback"), F.col("positive_ratio"), multiplier
        ),
    ).drop("_id", "_fid")


_SPECIAL = r"\\.^$|?*+()\[\]{}"
#: A file pattern that stands for one directory and all below it, as ``learned_rows`` writes them.
_OF_DIRECTORY = rf"^\^(?:(?:[^{_SPECIAL}]|\\[{_SPECIAL}])*/)?$"


def _directories(path: Column) -> Column:
    """The directories that hold a path, each with its last slash, and the empty one above them."""
    parts = F.split(path, "/", -1)
    deeper = F.transform(
        F.sequence(F.lit(0), F.size(parts) - 1),
        lambda n: F.when(n == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/"))),
    )
    return F.array_distinct(deeper)


def match_patterns(findings: DataFrame, learned: DataFrame) -> DataFrame:
    """(finding, pattern) rows: equal category plus regular expressions and a range.

    Patterns that name a directory, which all learned ones do, meet findings by equality of
    category and directory; only other patterns are tried against all findings of a category.
    """
    wanted = learned.filter("should_apply").withColumnsRenamed(
        {c: f"p_{c}" for c in learned.columns if c != "category"}
    )
    unset = lambda c: F.col(c).isNull() | (F.col(c) == "")
    rest = (
        (unset("p_code_pattern") | unset("code_snippet")
         | F.expr("code_snippet rlike p_code_pattern"))
        & (F.col("p_conf_min").isNull()
           | F.col("confidence").between(F.col("p_conf_min"), F.col("p_conf_max")))
    )
    of_directory = F.coalesce(F.col("p_file_pattern").rlike(_OF_DIRECTORY), F.lit(False))
    directory = F.regexp_replace(F.expr("substring(p_file_pattern, 2)"), r"\\(.)", "$1")
    below = wanted.filter(of_directory).withColumn("_directory", directory)
    spread = findings.withColumn("_directory", F.explode(_directories(F.col("file_path"))))
    below = F.broadcast(below) if fits(below) else below
    by_directory = spread.join(below, ["category", "_directory"]).filter(rest).drop("_directory")
    by_pattern = join_small(
        findings, wanted.filter(~of_directory), ["category"], salt_keys=["pr_id", "file_path", "line_start"]
    ).filter((unset("p_file_pattern") | F.expr("file_path rlike p_file_pattern")) & rest)
    return by_directory.unionByName(by_pattern)


def apply_patterns(findings: DataFrame, learned: DataFrame, keys: list[str]) -> DataFrame:
    """Findings with their confidence multiplied by every pattern that covers them.

    Patterns that ask for a directory only depend on category and path: while they are few they are looked up row by row, and
    only the other ones, if there are any, are joined by ``keys``.
    """
    wanted = cut(learned.filter("should_apply"))
    unset = F.col("code_pattern").isNull() | (F.col("code_pattern") == "")
    plain = F.coalesce(F.col("file_pattern").rlike(_OF_DIRECTORY) & unset & F.col("conf_min").isNull(), F.lit(False))
    directory = F.regexp_replace(F.expr("substring(file_pattern, 2)"), r"\\(.)", "$1")
    by_place = wanted.filter(plain).groupBy("category", directory.alias("_directory")).agg(
        F.product("confidence_multiplier").alias("_m")).where("_m IS NOT NULL AND category IS NOT NULL")
    out, factors = findings, []
    if fits(by_place):
        places = by_place.groupBy("category").agg(F.map_from_entries(F.collect_list(F.struct("_directory", "_m"))).alias("_places"))
        hits = F.filter(F.transform(_directories(F.col("file_path")), lambda d: F.try_element_at("_places", d)), lambda m: m.isNotNull())
        out = out.join(F.broadcast(places), "category", "left").withColumn("_hits", hits)
        factors.append(F.when(F.size("_hits") > 0, F.aggregate("_hits", F.lit(1.0), lambda x, m: x * m)))
        wanted = wanted.filter(~plain)
    if not factors or not wanted.isEmpty():
        factor = match_patterns(findings, wanted).groupBy(*keys).agg(F.product("p_confidence_multiplier").alias("_factor"))
        out = out.join(factor, keys, "left")
        factors.append(F.col("_factor"))
    found = reduce(lambda x, y: x | y, (f.isNotNull() for f in factors))
    product = reduce(lambda x, y: x * y, (F.coalesce(f, F.lit(1.0)) for f in factors))
    return out.withColumn("confidence", F.when(found, scoring.clamp(F.col("confidence") * product, 0.0, 1.0)).otherwise(
        F.col("confidence"))).select(*findings.columns)


def apply_category_multipliers(findings: DataFrame, adjustments: DataFrame) -> DataFrame:
    small = cut(adjustments.select("category", F.col("multiplier").alias("_m")))  # few rows, worked out once for their check and the join
    return join_small(
        findings, small, ["category"], "left", salt_keys=["pr_id", "file_path", "line_start"]
    ).withColumn(
        "confidence",
        F.when(F.col("_m").isNull(), F.col("confidence")).otherwise(
            scoring.clamp(F.col("confidence") * F.col("_m"), 0.0, 1.0)
        ),
    ).drop("_m")
