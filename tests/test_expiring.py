"""Counters kept as state: sessions across arrivals, and state that goes."""

import datetime as dt
import os
import random
import time

from pyspark.sql import functions as F

from revsieve.plans.lineage import new_dir
from revsieve.streaming import counters, expiring, sinks

SCHEMA = "analysis_result_id string, feedback_type string, ts timestamp, id string"
START = dt.datetime(2024, 1, 1)


def arrivals(spark, batches):
    """A stream that takes one file of rows at a time."""
    folder = new_dir(spark, "arrivals")
    os.makedirs(folder)
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        newest = max((f.path for f in os.scandir(folder) if f.name.endswith(".parquet")), key=os.path.getmtime)
        os.utime(newest, (1_700_000_000 + k, 1_700_000_000 + k))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder), spark.read.schema(SCHEMA).parquet(folder)


def feedback(seed=4, n=300):
    rng = random.Random(seed)
    kinds = ["positive", "negative", "neutral", "correction", "ignored", None]
    rows = [(f"f{rng.choice([0, 0, 0, 1, 2, 3, 4])}", rng.choice(kinds), START + dt.timedelta(hours=rng.randrange(600)), str(i)) for i in range(n)]
    rows.sort(key=lambda r: r[2])
    return rows


def test_sessions_over_arrivals_equal_the_table(spark):
    rows = feedback()
    # within an arrival in any order, and across arrivals out of order within the delay
    rng = random.Random(1)
    cuts = [rows[:80], rows[80:81], rows[81:200], rows[200:]]
    cuts[0], cuts[1] = [r for i, r in enumerate(cuts[0]) if i % 7 or i < 65], cuts[1] + [r for i, r in enumerate(cuts[0]) if i % 7 == 0 and i >= 65]
    for part in cuts:
        rng.shuffle(part)
    stream, table = arrivals(spark, cuts)
    got = sorted(map(tuple, sinks.collect_state(expiring.kept_sessions(stream, "570 minutes", "48 hours"), "kept").collect()))
    done = max(r[2] for c in cuts for r in c) - dt.timedelta(hours=48)
    want = sorted(tuple(r) for r in counters.sessions(table, "570 minutes").collect() if r["end"] <= done)
    assert got == want and len(got) > 20


def test_a_gap_of_exactly_the_length_ends_a_session(spark):
    hours = [0, 5, 10, 14, 100]
    rows = [("f", "positive", START + dt.timedelta(hours=h), str(h)) for h in hours]
    stream, _ = arrivals(spark, [[r] for r in rows])
    got = sorted(map(tuple, sinks.collect_state(expiring.kept_sessions(stream, "5 hours", "1 hour"), "kept").select("start", "total_count").collect()))
    assert got == [(START, 1), (START + dt.timedelta(hours=5), 1), (START + dt.timedelta(hours=10), 2)]


def test_odd_feedback(spark):
    rows = [(None, "positive", START, "a"), ("f", "positive", None, "b"), ("f", None, START, "c"), ("g", "odd", START + dt.timedelta(days=9), "d")]
    stream, _ = arrivals(spark, [rows])
    got = sinks.collect_state(expiring.kept_sessions(stream, "1 day", "1 hour"), "kept").collect()
    assert [(r.analysis_result_id, r.total_count, r.positive_count) for r in got] == [("f", 1, 0)]


def test_clock_counters_go_after_their_time(spark):
    """A counter grows while it is renewed; after its time it starts again from nothing."""
    folder, out, check = (new_dir(spark, n) for n in ("in", "out", "check"))

    def run(ttl, rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(SCHEMA).parquet(folder)
        with expiring.rocks_state(spark, by_clock=True):
            sinks.batch_table(expiring.renewed_counts(stream, ttl), out, check).awaitTermination()
        return {r["analysis_result_id"]: r["total_count"] for r in sinks.newest_rows(
            spark, out, f"analysis_result_id string, {expiring.COUNT_SCHEMA}", ["analysis_result_id"]).collect()}

    one = ("f", "positive", START, "1")
    assert run("1 hour", [one, one, ("g", "negative", START, "2")]) == {"f": 2, "g": 1}
    assert run("1 hour", [one]) == {"f": 3, "g": 1}

    folder, out, check = (new_dir(spark, n) for n in ("in", "out", "check"))
    assert run("2 seconds", [one, one]) == {"f": 2}
    time.sleep(4)
    assert run("2 seconds", [one]) == {"f": 1}


def test_parts_put_together_before_the_shuffle(spark):
    rows = [("hot", "positive", START + dt.timedelta(seconds=i), str(i)) for i in range(5000)]
    parts = expiring.put_together(spark.createDataFrame(rows, SCHEMA).coalesce(2), "1 day")
    assert parts.count() <= 4
    assert parts.agg(F.sum("total_count"), F.sum("positive_count")).first() == (5000, 5000)
