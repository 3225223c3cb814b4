import datetime as dt

from pyspark.sql import functions as F

from revsieve.operators import feedback as fb
from revsieve.functions import feedback_text as ft
from revsieve.functions import scoring
from revsieve.plans import joins
from revsieve.plans import review as rv
from revsieve.plans.lineage import new_dir
from revsieve.sources import readers, team, writers
from revsieve.streaming import counters, events, sinks


def test_replies_and_reactions(spark):
    df = spark.createDataFrame([("incorrect",), ("should be x",), ("WRONG",), ("hm",), ("",)], "t string")
    got = [(r.k, r.w) for r in df.select(
        ft.reply_type(F.col("t")).alias("k"), ft.reply_type(F.col("t"), True).alias("w")).collect()]
    assert got == [("positive", "negative"), ("correction", "correction"), ("negative", "negative"),
                   ("neutral", "neutral"), ("neutral", "neutral")]
    r = spark.createDataFrame([("+1",), ("THUMBS_DOWN",), ("eyes",), (None,)], "r string")
    assert [x.k for x in r.select(ft.reaction_type(F.col("r")).alias("k")).collect()] == [
        "positive", "negative", "neutral", "neutral"]


def test_multipliers_and_levels(spark):
    df = spark.createDataFrame([("positive", 1), ("positive", 50), ("negative", 3), ("correction", 9), ("other", 9)], "k string, n int")
    got = [round(r.m, 6) for r in df.select(scoring.feedback_multiplier(F.col("k"), F.col("n")).alias("m")).collect()]
    assert got == [1.2, 1.3, 0.7, 0.95, 1.0]
    c = spark.createDataFrame([(0.95,), (0.7,), (0.5,), (0.3,), (0.1,)], "c double")
    assert [r.l for r in c.select(scoring.confidence_level(F.col("c")).alias("l")).collect()] == [
        "very_high", "high", "medium", "low", "very_low"]


def test_ignored_counts_in_the_total_only(spark):
    df = spark.createDataFrame([("f", k) for k in ("positive", "ignored", "negative", "positive")], "analysis_result_id string, feedback_type string")
    r = fb.stats(df).first()
    assert (r.total_feedback, r.positive_count, r.negative_count, r.neutral_count, r.positive_ratio) == (4, 2, 1, 0, 0.5)


def test_newest_first_is_one_sequence_across_buckets(spark):
    rows = [("hot", f"{i:04d}", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=7 * i)) for i in range(300)]
    df = spark.createDataFrame(rows, "analysis_result_id string, id string, ts timestamp")
    got = [(r.position, r.id) for r in fb.newest_first(df).orderBy("position").collect()]
    assert got == [(i + 1, f"{299 - i:04d}") for i in range(300)]


def test_salted_join_equals_broadcast_join(spark):
    left = spark.range(500).select((F.col("id") % 3).cast("string").alias("category"), F.col("id").alias("pr_id"))
    small = spark.createDataFrame([("0", 1.5), ("1", 0.5)], "category string, m double")
    rows = lambda df: sorted((r.pr_id, r.m) for r in df.collect() if r.m is not None)
    a = joins.join_small(left, small, ["category"], "left")
    b = joins.join_small(left, small, ["category"], "left", max_rows=1, salt_keys=["pr_id"])
    assert rows(a) == rows(b) and a.count() == b.count() == 500


def test_pattern_application(spark):
    found = spark.createDataFrame(
        [("p", 1, "bug", "a/x.py", 0.8, "eval(x)"), ("p", 2, "bug", "b/x.py", 0.8, None), ("p", 3, "test", "a/x.py", 0.5, None)],
        "pr_id string, line_start int, category string, file_path string, confidence double, code_snippet string")
    learned = spark.createDataFrame(
        [("1", "bug", "^a/", "eval", 0.5, None, None, True), ("2", "bug", None, None, 1.5, 0.9, 1.0, True),
         ("3", "bug", None, None, 0.1, None, None, False), ("4", "test", "", "zzz", 1.2, 0.0, 0.5, True)],
        "pattern_id string, category string, file_pattern string, code_pattern string, confidence_multiplier double, conf_min double, conf_max double, should_apply boolean"
    ).withColumn("file_path", F.lit(None)).drop("file_path")
    got = {r.line_start: round(r.confidence, 6) for r in fb.apply_patterns(
        found.withColumn("file_path", F.col("file_path")), learned, ["pr_id", "line_start"]).collect()}
    assert got == {1: 0.4, 2: 0.8, 3: 0.6}


def test_fixed_findings(spark):
    cols = "pr_id string, analysis_result_id string"
    marked = fb.from_fixes(fb.mark_fixed(
        spark.createDataFrame([("p", "a"), ("p", "b")], cols), spark.createDataFrame([("p", "b"), ("q", "a")], cols)))
    assert {(r.analysis_result_id, r.feedback_type) for r in marked.collect()} == {("a", "positive"), ("b", "negative")}


def test_routing_of_odd_events(spark):
    rows = [("pull_request", '{"action":"opened"}'), ("pull_request", "{bad"), (None, "{}"), ("ping", "{}"), ("pull_request", "{}")]
    got = [(r.status, r.reason) for r in events.route(spark.createDataFrame(rows, "event_type string, payload string")).collect()]
    assert got[0] == ("error", "Missing required PR information")
    assert got[2] == ("error", "Missing event type") and got[3][0] == "pong"
    assert got[4] == ("skipped", "Action 'None' not processed")
    assert got[1] == ("error", "Invalid JSON")


def test_streams_equal_tables(spark):
    rows = [("f%d" % (i % 4), "positive" if i % 3 else "negative", "bug", dt.datetime(2024, 1, 1) + dt.timedelta(hours=5 * i), str(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "analysis_result_id string, feedback_type string, category string, ts timestamp, id string")
    folder = new_dir(spark, "in")
    df.write.parquet(folder)
    stream = lambda: spark.readStream.schema(df.schema).parquet(folder)
    day = sinks.collect_update(counters.per_day(stream(), "1 day"), "d", ["day"])
    assert sorted(map(tuple, day.collect())) == sorted(map(tuple, counters.per_day(df).collect()))
    done = dt.datetime(2024, 1, 1) + dt.timedelta(hours=5 * 199 - 1)
    for build in (lambda x, d: counters.sessions(x, "18 hours", d), lambda x, d: counters.sliding_counts(x, "3 days", "1 day", d)):
        got = sorted(map(tuple, sinks.collect_append(build(stream(), "1 hour"), "s").collect()))
        want = sorted(tuple(r) for r in build(df, None).collect() if r["end"] <= done)
        assert got == want and got
    assert sinks.collect_append(counters.drop_repeats(stream()), "u").count() == 200


def test_team_files(spark):
    folder = new_dir(spark, "team")
    assert team.load(spark, folder + "/none.json").first().coding_conventions.max_line_length == 100
    writers.write_table(spark.createDataFrame([("{not json",)], "value string"), folder + "/bad", fmt="text")
    assert len(team.load(spark, folder + "/bad").first().known_patterns) == 3
    own = team.add_pattern(team.add_pattern(team.defaults(spark), "Own"), "Own")
    team.save(own.drop("team_name"), folder + "/own")
    assert team.load(spark, folder + "/own", "t").first().known_patterns[-1] == "Own"


def test_tables_round_trip(spark):
    folder = new_dir(spark, "t")
    row = spark.createDataFrame([("p", 1, "a.py", 1, 1, 2, "+x", "added", "python")],
                                "pr_id string, file_ord int, file_path string, additions int, deletions int, changes int, diff string, status string, language string")
    writers.write_table(row, folder)
    assert readers.read_table(spark, folder, "file_diffs").collect() == row.collect()


def test_review_plan_has_no_python_and_no_cartesian(spark, diffs_of):
    plan = rv.review(diffs_of(("p", 1, "a.py", "python", "modified", 1, "+x")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "WindowGroupLimit" in plan


def test_directory_patterns_are_looked_up_without_a_join_of_the_findings(spark, monkeypatch):
    def joined(*_):
        raise AssertionError("findings are matched by a join")

    monkeypatch.setattr(fb, "match_patterns", joined)
    found = spark.createDataFrame(
        [("r", 1, "src/a/x.py", "security", 0.5), ("r", 2, "src/b.py", "security", 0.5), ("r", 3, "src/a/x.py", "bug", 0.5), ("r", 4, None, "bug", 0.5)],
        "pr_id string, line_start int, file_path string, category string, confidence double")
    learned = spark.createDataFrame(
        [("security", "^src/a/", 0.7, True), ("security", "^src/", 1.2, True), ("security", "^src/", 0.5, False), ("bug", "^lib/", 0.1, True)],
        "category string, file_pattern string, confidence_multiplier double, should_apply boolean").withColumns({
            "pattern_id": F.lit("p"), "code_pattern": F.lit(None).cast("string"), "conf_min": F.lit(None).cast("double"),
            "conf_max": F.lit(None).cast("double")})
    got = {r.line_start: round(r.confidence, 6) for r in fb.apply_patterns(found, learned, ["pr_id", "line_start"]).collect()}
    assert got == {1: 0.42, 2: 0.6, 3: 0.5, 4: 0.5}


def test_category_records_are_worked_out_once(spark):
    """The check of their size and the join with the findings read the finished rows; the feedback is grouped once."""
    grouped = spark.createDataFrame([("bug",)] * 6, "category string").groupBy("category").agg((F.count("*") / 5).alias("multiplier"))
    found = spark.createDataFrame([("p", "a", 1, "bug", 0.5), ("p", "b", 1, "style", 0.5)],
                                  "pr_id string, file_path string, line_start int, category string, confidence double")
    got = fb.apply_category_multipliers(found, grouped)
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.category, r.confidence) for r in got.collect()} == {("bug", 0.6), ("style", 0.5)}
