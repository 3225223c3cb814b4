"""Cases that earlier versions got wrong."""

import datetime as dt
import os
import re
import subprocess
import sys
import warnings

from pyspark.sql import functions as F

from checks import inputs
from revsieve.functions import languages, text
from revsieve.operators import feedback as fb
from revsieve.operators import history as hist
from revsieve.operators.catalog import line_rule
from revsieve.plans import review as rv
from revsieve.plans.lineage import new_dir
from revsieve.streaming import sinks
from tests.conftest import SMALL

RANK = ("pr_id", "rank", "file_path", "line_start", "rule_no", "score")


def test_every_line_item_and_event_is_used(spark):
    table = lambda n: inputs.table(spark, SMALL, n)
    diffs = table("file_diffs")
    assert diffs.count() == table("lineitem").count()
    assert diffs.select("pr_id", "file_ord").distinct().count() == diffs.count()
    assert diffs.select("pr_id", "file_path").distinct().count() == diffs.count()
    assert table("feedback").count() == table("events").count()
    assert table("pr_versions").count() == table("events").count()


def test_review_stream_over_many_arrivals_equals_batch(spark):
    diffs = inputs.table(spark, SMALL, "file_diffs").where("pr_number % 10 = 1")
    folder = new_dir(spark, "arrivals")
    diffs.repartition(4).write.parquet(folder)
    stream = spark.readStream.schema(diffs.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    got = sinks.collect_reviews(stream, "arriving").select(*RANK)
    want = rv.review(spark.read.parquet(folder)).select(*RANK)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.groupBy("pr_id").agg(F.count("*").alias("n"), F.countDistinct("rank").alias("k")).where("n > 50 OR n != k").count() == 0


def test_file_and_its_test_in_two_arrivals(spark, diffs_of):
    folder = new_dir(spark, "two")
    diffs_of(("p", 1, "src/pay.py", "python", "added", 40, "+def pay():\n+    pass")).write.parquet(folder)
    diffs_of(("p", 2, "tests/test_pay.py", "python", "added", 40, "+def test_pay():\n+    assert pay")).write.mode("append").parquet(folder)
    schema = spark.read.parquet(folder).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    got = sorted(map(tuple, sinks.collect_reviews(stream, "two").select(*RANK).collect()))
    assert got == sorted(map(tuple, rv.review(spark.read.parquet(folder)).select(*RANK).collect()))


def test_identifiers_of_all_scripts(spark):
    code = "def größe(x):\n    pass\ndef имя(y):\n    pass"
    df = spark.createDataFrame([(code, "python")], "diff string, language string")
    got = df.select(languages.extract_functions(F.col("diff"), F.col("language")).alias("f")).first().f
    assert [r["name"] for r in got] == re.findall(r"def\s+(\w+)\s*\(", code)


def test_marker_characters_in_a_text(spark):
    line = "a ﷐ print(1) ﷑ print(2)"
    df = spark.createDataFrame([(line,)], "c string")
    got = df.select(text.matches_in_line(F.col("c"), r"print\(").alias("m")).first().m
    assert [m["match_ord"] for m in got] == [m["match_ord"] for m in spark.createDataFrame(
        [(line.replace("﷐", "x").replace("﷑", "x"),)], "c string").select(
        text.matches_in_line(F.col("c"), r"print\(").alias("m")).first().m]


def test_bad_custom_pattern_is_reported_and_the_others_run(spark, diffs_of):
    rules = [line_rule("broken", "(", "bug", "high", 0.9, "B", "s"), line_rule("zzz", "zzz", "bug", "high", 0.9, "Z", "s")]
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        found = rv.review(diffs_of(("p", 1, "a.py", "python", "modified", 1, "+zzz")), settings=rv.ReviewSettings(custom_rules=rules))
        assert found.count() >= 1
    assert any("broken" in str(w.message) for w in seen)
    assert [r.rule_id for r, _ in rv.rejected_rules(spark, rules)] == ["broken"]


def test_history_ends_at_as_of(spark):
    day = lambda m, d: dt.datetime(2024, m, d)
    prs = spark.createDataFrame(
        [("a", 1, "o", "r", day(1, 1)), ("b", 2, "o", "r", day(1, 2)), ("c", 3, "o", "r", day(6, 1))],
        "pr_id string, pr_number long, repo_owner string, repo_name string, created_at timestamp")
    got = {(r.pr_id, r.other_id) for r in hist.recent_in_repo(prs, F.lit(day(1, 2))).collect()}
    assert got == {("a", "b"), ("b", "a"), ("c", "a"), ("c", "b")}
    late = spark.createDataFrame([("bug", "positive", day(6, 1))] * 20, "category string, feedback_type string, ts timestamp")
    assert fb.patterns(late, F.lit(day(5, 20))).count() == 0


def test_vector_search_runs_from_another_folder(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from revsieve.operators import similarity as sim
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
rows = [(str(i), i, "b", [1.0, float(i % 3)]) for i in range(6)]
print("found", sim.vector_top_k(spark.createDataFrame(rows, "pr_id string, pr_number long, block string, embedding array<float>")).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert "found" in done.stdout, done.stderr[-2000:]


def test_learned_patterns_by_directory_and_by_expression(spark):
    paths = ["src/api/a.py", "src/api.x/b.py", "src/apiXx/b.py", "top.py", "src//c.py", "lib/api/a.py", "/root.py"]
    patterns = ["^src/api/", r"^src/api\.x/", "^", "^src/", "^src//", r"api/.*\.py$", "", None, "^/", "^src/a", r"^src/a[pq]i/"]
    findings = spark.createDataFrame(
        [("p", 1, 1, i, 1, "bug", f, 0.8, "snippet") for i, f in enumerate(paths)],
        "pr_id string, file_ord int, rule_no int, line_start int, match_ord int, category string, file_path string, confidence double, code_snippet string")
    learned = spark.createDataFrame(
        [(str(i), "bug", x, "snip" if i % 2 else None, 0.5 if i % 3 else None, 0.9 if i % 3 else None, True, 1.2) for i, x in enumerate(patterns)],
        "pattern_id string, category string, file_pattern string, code_pattern string, conf_min double, conf_max double, should_apply boolean, confidence_multiplier double")
    got = {(r.file_path, r.p_pattern_id) for r in fb.match_patterns(findings, learned).collect()}
    assert got == {(f, str(i)) for f in paths for i, x in enumerate(patterns) if not x or re.search(x, f)}
    assert fb.match_patterns(findings, learned).count() == len(got)


def test_review_makes_vectors_of_texts(spark, diffs_of):
    prs = spark.createDataFrame(
        [(f"o/r#{i}", i, "o", "r", "open", f"Change the parser of module {i // 2}", None, dt.datetime(2024, 1, 1)) for i in range(4)],
        "pr_id string, pr_number long, repo_owner string, repo_name string, state string, title string, description string, created_at timestamp")
    diffs = diffs_of(*[(f"o/r#{i}", 1, f"src/m{i // 2}_{i}.py", "python", "modified", 1, "+x") for i in range(4)])
    similar = rv.context(prs, diffs, F.lit(dt.datetime(2024, 1, 2)), text_vectors=True)["similar"].collect()
    best = {r.pr_id: (r.other_id, r.method) for r in similar if r.similar_rank == 1}
    assert best["o/r#0"] == ("o/r#1", "vector_search") and best["o/r#3"] == ("o/r#2", "vector_search")


def test_broadcast_looks_at_rows_and_bytes(spark):
    from revsieve.plans.joins import fits

    wide = spark.range(10).select("id", F.repeat(F.lit("x"), 1000).alias("s"))
    assert fits(wide) and not fits(wide, max_rows=9) and not fits(wide, max_bytes=5000)
    assert fits(wide.limit(0), max_bytes=0)
