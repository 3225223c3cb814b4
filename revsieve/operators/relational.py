"""Rules that compare the files of one pull request with each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revsieve.operators.catalog import RuleBook
from revsieve.operators.ranking import top_per_key
from revsieve.plans.lineage import cut

MISSING_TESTS = "missing_tests"
SIGNIFICANT_CHANGES = 10  # Fixed value: smaller changes need no test.
SMALL_SET = 64  # test files per pull request that are compared as one array
GRAMS = (64, 32, 16, 8, 4, 2, 1)


def _base_name(path: Column) -> Column:
    return F.replace(F.replace(path, F.lit(".py"), F.lit("")), F.lit(".js"), F.lit(""))


def _stripped(path: Column) -> Column:
    return F.replace(F.replace(path, F.lit("test_"), F.lit("")), F.lit("_test"), F.lit(""))


def _gram_size(base: Column) -> Column:
    size = F.lit(0)
    for g in reversed(GRAMS):
        size = F.when(F.length(base) >= g, g).otherwise(size)
    return size


def _grams(path: Column, sizes: Column) -> Column:
    """All substrings of the gram lengths in ``sizes``; 0 stands for the empty one."""
    per_size = [
        F.when(
            F.array_contains(sizes, g) & (F.length(path) >= g),
            F.transform(
                F.sequence(F.lit(1), F.length(path) - (g - 1)), lambda i: F.substring(path, i, g)
            ),
        ).otherwise(F.array().cast("array<string>"))
        for g in GRAMS
    ]
    empty = F.when(F.array_contains(sizes, 0), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*per_size, empty))


def missing_tests(
    diffs: DataFrame, book: RuleBook, strict: bool = False, small_set: int = SMALL_SET
) -> DataFrame:
    """Changed files without a test in the same pull request.

    A file has a test if some test path contains its base name, or equals it once
    the test marks are removed. With ``strict`` every changed file counts as a test,
    the file itself included, so a file that covers itself needs no other one.

    Pull requests with few tests carry them as one short array. In the others, test
    paths are cut into substrings, of the lengths that their own files ask for, and meet the tail of a base name
    by equality, so no pull request pairs all its files with all its tests. The short arrays are written out first: whether
    any pull request has many tests is known then, and the files are read a second time only, not once for each step of both ways.
    """
    no = book.by_id[MISSING_TESTS]
    is_test = F.lower("file_path").contains("test")
    live = diffs.filter(F.col("status") != "removed")
    candidates = (
        live.filter(~is_test & (F.col("changes") > SIGNIFICANT_CHANGES))
        .select("pr_id", "file_ord", "file_path", "changes")
        .withColumn("base", _base_name(F.col("file_path")))
    )

    def covers(t: Column, base: Column) -> Column:
        return t.contains(base) | (_stripped(t) == base)

    if strict:  # the file itself is one of the tests
        candidates = candidates.filter(~covers(F.col("file_path"), F.col("base")))
    tests = (live if strict else live.filter(is_test)).select(
        "pr_id", F.col("file_path").alias("test_path")
    ).distinct()
    if strict:
        tests = tests.join(candidates.select("pr_id"), "pr_id", "left_semi")

    few = cut(
        top_per_key(tests, ["pr_id"], [F.col("test_path")], small_set + 1, "_rn")
        .groupBy("pr_id")
        .agg(F.collect_list("test_path").alias("tests"))
    )
    with_few = candidates.join(few, "pr_id", "left")
    n = F.coalesce(F.size("tests"), F.lit(0))

    found_in_few = F.coalesce(F.exists("tests", lambda t: covers(t, F.col("base"))), F.lit(False))
    lacking_few = with_few.filter((n <= small_set) & ~found_in_few).drop("tests")

    def as_findings(lacking: DataFrame) -> DataFrame:
        return lacking.select(
            "pr_id", "file_ord", "file_path",
            F.lit(no).alias("rule_no"), F.lit(1).alias("line_start"),
            F.col("changes").cast("string").alias("arg"),
            F.lit(None).cast("string").alias("code_snippet"),
            F.lit(0).alias("match_ord"),
            F.lit(book.rules[no - 1].confidence).alias("confidence"),
        )

    big_prs = few.filter(F.size("tests") > small_set).select("pr_id")
    if big_prs.isEmpty():
        return as_findings(lacking_few)
    big_tests = tests.join(big_prs, "pr_id", "left_semi")
    asked = with_few.filter(n > small_set).withColumn("size", _gram_size(F.col("base"))).groupBy("pr_id").agg(
        F.collect_set("size").alias("sizes"))
    grams = big_tests.join(asked, "pr_id").select(
        "pr_id", "test_path", F.explode(_grams(F.col("test_path"), F.col("sizes"))).alias("gram")
    )
    equal = big_tests.select("pr_id", _stripped(F.col("test_path")).alias("base")).distinct()
    base = F.col("base")
    in_big = (
        with_few.filter(n > small_set)
        .drop("tests")
        .withColumn("gram", F.when(base == "", "").otherwise(
            F.substring(base, F.length(base) - _gram_size(base) + 1, 64)))
    )
    g = grams.alias("g")
    lacking_big = (
        in_big.join(equal, ["pr_id", "base"], "left_anti").alias("c")
        .join(
            g,
            (F.col("c.pr_id") == F.col("g.pr_id"))
            & (F.col("c.gram") == F.col("g.gram"))
            & F.col("g.test_path").contains(F.col("c.base")),
            "left_anti",
        )
        .drop("gram")
    )
    return as_findings(lacking_few.unionByName(lacking_big))
