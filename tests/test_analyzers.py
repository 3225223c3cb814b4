"""Analyzers of the user's own, and the switches for learning."""

import pytest
from pyspark.sql import functions as F

from revsieve.operators.catalog import Rule
from revsieve.plans import review as rv
from revsieve.plans.analyzers import Analyzer, of_columns

SECRET = ("p", 1, "src/a.py", "python", "modified", 3, '+password = "hunter2"\n')


def rule(rule_id, confidence=0.9, **more):
    return Rule(rule_id, "", "bug", "critical", confidence, f"Title of {rule_id}", "In {path}: {arg}", "Do it", arg_key="what", **more)


def ids(df, book):
    return [(r.rule_id, r.arg, round(r.confidence, 6)) for r in book.describe(df).orderBy("pr_id", "rank").collect()]


def test_own_rules_are_ranked_with_the_others(spark, diffs_of):
    found = lambda d: d.groupBy("pr_id").agg(F.min("file_path").alias("file_path")).select(
        "pr_id", "file_path", F.lit("mine").alias("rule_id"), F.lit("seen").alias("arg"), F.lit(5.0).alias("confidence"))
    settings = rv.ReviewSettings(analyzers=[Analyzer("own", (rule("mine"),), found)])
    book = settings.book()
    top = rv.review(diffs_of(SECRET), settings=settings)
    assert ids(top, book)[1] == ("mine", "seen", 0.9) and not settings.failed
    text = book.describe(top).where("rule_id = 'mine'").first()
    assert (text.description, text.metadata, text.analyzer, text.priority) == ("In src/a.py: seen", {"what": "seen"}, "own", "critical")


def test_conditions_of_a_file(spark, diffs_of):
    own = of_columns("paths", [(rule("py"), lambda: F.col("file_path").endswith(".py")), (rule("rare"), lambda: F.lit(False)),
                               (rule("null"), lambda: F.lit(None).cast("boolean")), (rule("low", 0.2), lambda: F.lit(True))])
    settings = rv.ReviewSettings(analyzers=[own])
    top = rv.review(diffs_of(SECRET), settings=settings)
    assert [i for i, _, _ in ids(top, settings.book()) if i in ("py", "rare", "null", "low")] == ["py"]


def test_failing_analyzers_are_reported_and_left_out(spark, diffs_of):
    def raises(d):
        raise KeyError("lost")

    bad = [
        Analyzer("planned badly", (rule("a"),), lambda d: d.select("no_column")),
        Analyzer("raises", (rule("b"),), raises),
        Analyzer("runs badly", (rule("c"),), lambda d: d.select("pr_id", "file_path", F.raise_error(F.lit("down")).alias("rule_id"))),
        Analyzer("foreign rule", (rule("d"),), lambda d: d.select("pr_id", "file_path", F.lit("hardcoded_secret").alias("rule_id"))),
    ]
    good = of_columns("good", [(rule("fine"), lambda: F.lit(True))])
    settings = rv.ReviewSettings(analyzers=[*bad, good])
    with pytest.warns(UserWarning):
        top = rv.review(diffs_of(SECRET), settings=settings)
    assert [n for n, _ in settings.failed] == [a.name for a in bad] and all(r for _, r in settings.failed)
    assert "fine" in {i for i, _, _ in ids(top, settings.book())}
    plain = rv.review(diffs_of(SECRET))
    assert top.count() == plain.count() + 1


def test_names_are_not_repeated():
    with pytest.raises(ValueError):
        rv.ReviewSettings(analyzers=[Analyzer("x", (rule("hardcoded_secret"),), None)]).book()
    with pytest.raises(ValueError):
        rv.ReviewSettings(analyzers=[Analyzer("security", (rule("z"),), None)]).book()


def test_learning_lifts_what_lies_below_the_threshold(spark, diffs_of):
    """A rule of 0.55 is reported once its category's record or a learned pattern lifts it over 0.6."""
    diffs = diffs_of(("p", 1, "api/routes.py", "python", "modified", 3, "+import sqlalchemy\n+@app.route('/x')\n+def f():\n+    return db.query(X)\n"))
    kinds = lambda s: {r.rule_no for r in rv.review(diffs, settings=s).collect()}
    book = rv.ReviewSettings().book()
    below = {n for n in book.numbers(0.0) if book.rules[n - 1].confidence < 0.6}
    categories = spark.createDataFrame([(c, 1.3) for c in ("architecture", "performance", "security")], "category string, multiplier double")
    lifted = kinds(rv.ReviewSettings(category_adjustments=categories)) - kinds(rv.ReviewSettings())
    everything = {r.rule_no for r in rv.all_findings(diffs, book).collect()}
    want = {n for n in everything & below if book.rules[n - 1].confidence * 1.3 >= 0.6
            and book.rules[n - 1].category in ("architecture", "performance", "security")}
    assert lifted == want
    learned = spark.createDataFrame([("1", "security", "^api/", "", 0.1, None, None, True)],
                                    "pattern_id string, category string, file_pattern string, code_pattern string, confidence_multiplier double, conf_min double, conf_max double, should_apply boolean")
    left = kinds(rv.ReviewSettings(learned_patterns=learned))
    assert not {n for n in left if book.rules[n - 1].category == "security"}


def test_many_bad_patterns_take_one_job_if_all_are_good(spark):
    good = [rule(f"g{i}", pattern="a+") for i in range(3)]
    assert rv.rejected_rules(spark, good) == [] and rv.rejected_rules(spark, []) == []
    bad = rule("bad", pattern="(")
    assert [r.rule_id for r, _ in rv.rejected_rules(spark, [*good, bad])] == ["bad"]
