"""Feeds with a second output for what they reject."""

import json

from pyspark.sql import functions as F

from revsieve.plans.lineage import new_dir
from revsieve.sources import feeds

GOOD = {"analysis_result_id": "a", "pr_id": "o/r#1", "pr_number": 1, "repo_owner": "o", "repo_name": "r", "feedback_type": "positive",
        "source": "manual", "reviewer": "u", "category": "bug", "file_path": "a.py", "line_number": 3}


def changed(**fields):
    return json.dumps({k: v for k, v in (GOOD | fields).items() if v != "drop"})


CASES = [
    (changed(), None), (changed(id="7", comment="x", metadata={"k": "v"}, ts="2024-01-01T00:00:00"), None), (changed(unknown=5), None),
    (changed(feedback_type="ignored", source="auto_detected"), None), (changed(line_number=0), None),
    (None, "Empty line"), ("", "Empty line"), (" \t", "Empty line"), ("{", "Invalid JSON"), ("nonsense", "Invalid JSON"), ("[]", "Not an object"),
    ("3", "Not an object"), ('"text"', "Not an object"), ("null", "Not an object"), ("{}", "Missing analysis_result_id"),
    (changed(reviewer="drop"), "Missing reviewer"), (changed(reviewer=None), "Missing reviewer"), (changed(reviewer=""), "Missing reviewer"),
    (changed(pr_number="one"), "Wrong type of pr_number"), (changed(line_number=[1]), "Wrong type of line_number"),
    (changed(feedback_type="great"), "Unknown feedback_type 'great'"), (changed(source="Manual"), "Unknown source 'Manual'"),
    (changed(line_number=-1), "Negative line_number"), (changed(ts="yesterday"), "Wrong type of an optional field"),
    (changed(feedback_type="great", source="fax"), "Unknown feedback_type 'great'"),
]


def test_reasons(spark):
    df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(CASES)], "n int, value string")
    got = {r.n: r.reason for r in feeds.checked_feedback(df).collect()}
    assert got == {i: reason for i, (_, reason) in enumerate(CASES)}


def test_both_outputs_add_up(spark):
    df = spark.createDataFrame([(i, v, "x", "y") for i, (v, _) in enumerate(CASES)], "n int, value string, reason string, pr_id string").repartition(4)
    checked, folder = feeds.checked_feedback(df), new_dir(spark, "feed")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in checked.schema.fields)
    feeds.split_table(checked, folder)
    feeds.split_table(checked.where("false"), folder)
    good, bad = feeds.accepted(spark, folder, schema), feeds.rejected(spark, folder, schema)
    assert good.count() == sum(r is None for _, r in CASES) and good.count() + bad.count() == len(CASES)
    assert {r.raw for r in bad.collect()} == {v for v, reason in CASES if reason}
    assert {r.pr_id for r in good.collect()} == {"o/r#1"}
    assert all("accepted=true" in f for f, in good.select(F.input_file_name()).distinct().collect())


def test_events_of_the_wrong_kind_only(spark):
    whole = '{"action":"opened","pull_request":{"number":1},"repository":{"name":"r","owner":{"login":"o"}}}'
    rows = [("pull_request", whole), ("pull_request", whole[:-2]), (None, whole), ("pull_request", whole.replace("1}", '"one"}')), ("ping", "{}"), ("push", "{}")]
    got = [(r.status, r.reason) for r in feeds.checked_events(spark.createDataFrame(rows, "event_type string, payload string")).collect()]
    assert got == [("ok", None), ("error", "Invalid JSON"), ("error", "Missing event type"), ("error", "Missing required PR information"),
                   ("pong", None), ("ignored", None)]
