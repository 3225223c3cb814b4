"""Stored tables over several loads, and the review stream that reads only what it must."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from revsieve.plans import review as rv
from revsieve.plans.lineage import new_dir
from revsieve.sources import writers
from revsieve.sources.stored import StoredTable
from revsieve.streaming import sinks

SCHEMA = "k string, at int, value string"


def table(spark, **more):
    return StoredTable(spark, new_dir(spark, "stored"), SCHEMA, ["k"], ["at"], 8, **more)


def rows(spark, *given):
    return spark.createDataFrame(list(given), SCHEMA)


def content(t):
    return sorted(map(tuple, t.read().collect()), key=str)


def files(folder, buckets=None):
    found = glob.glob(f"{folder}/rows/_bucket=*/*.parquet")
    return {f: os.path.getmtime(f) for f in found if buckets is None or int(f.split("_bucket=")[1].split("/")[0]) in buckets}


def test_newest_row_of_each_key(spark):
    t = table(spark)
    assert content(t) == []
    first = rows(spark, ("a", 1, "a1"), ("b", 5, "b5"), ("b", 4, "b4"), ("c", 1, "c1"), (None, 1, "n"), ("e", None, "e?"))
    t.upsert(first, 1)
    t.upsert(rows(spark, ("a", 2, "a2"), ("b", 4, "late"), ("c", 1, "c1 again"), ("d", 1, "d1"), ("e", 0, "e0")), 2)
    want = sorted([("a", 2, "a2"), ("b", 5, "b5"), ("c", 1, "c1 again"), ("d", 1, "d1"), (None, 1, "n"), ("e", 0, "e0")], key=str)
    assert content(t) == want
    t.upsert(first, 1)
    assert content(t) == want
    assert t.versions().count() == len(want)
    t.upsert(rows(spark), 3)
    assert content(t) == want


def test_other_buckets_stay_as_they_are(spark):
    t = table(spark)
    t.upsert(rows(spark, *((f"k{i}", 1, "x") for i in range(100))), 1)
    change = rows(spark, ("k7", 2, "y"))
    (own,) = t.touched(change)
    before = files(t.folder)
    t.upsert(change, 2)
    after = files(t.folder)
    others = set(range(8)) - {own}
    assert files(t.folder, others) == {f: m for f, m in before.items() if f"_bucket={own}/" not in f}
    assert set(after) != set(before)
    read = {r[0] for r in t.versions([own]).select(F.input_file_name()).distinct().collect()}
    assert read and all(f"_bucket={own}/" in f for f in read)


def test_interrupted_compaction_is_taken_up(spark, monkeypatch):
    t = table(spark)
    t.append(rows(spark, ("a", 1, "old"), ("b", 1, "b")), 1)
    t.append(rows(spark, ("a", 2, "new")), 2)
    real = t._written

    def fails(df, folder, mode):
        if folder.endswith("stored/rows") or (folder == f"{t.folder}/rows" and mode == "overwrite"):
            raise OSError("lost")
        real(df, folder, mode)

    monkeypatch.setattr(t, "_written", fails)
    with pytest.raises(OSError):
        t.compact(list(range(8)), "x")
    assert content(t) == [("a", 2, "new"), ("b", 1, "b")]
    monkeypatch.setattr(t, "_written", real)
    t.compact(list(range(8)), "x")
    assert content(t) == [("a", 2, "new"), ("b", 1, "b")] and t.versions().count() == 2
    assert not os.path.exists(f"{t.folder}/aside/x")


def test_stored_history_of_two_loads(spark):
    prs = lambda n, title: spark.createDataFrame(
        [(f"o/r#{i}", i, title, "o", "r", "d", i) for i in n], "pr_id string, pr_number long, title string, repo_owner string, repo_name string, description string, updated_at int")
    diffs = lambda n, name: spark.createDataFrame(
        [(f"o/r#{i}", 1, name, "python", "modified", 1, "+import a.b\n") for i in n],
        "pr_id string, file_ord int, file_path string, language string, status string, changes int, diff string")
    folder = new_dir(spark, "history")
    one = writers.store_history(prs(range(4), "one"), diffs(range(4), "x.py"), folder, 1, 4)
    first = {r.pr_id: list(r.embedding) for r in one["pr_embeddings"].read().collect()}
    two = writers.store_history(prs(range(2, 6), "two words"), diffs(range(2, 6), "y.py"), folder, 2, 4)
    writers.store_history(prs(range(2, 6), "two words"), diffs(range(2, 6), "y.py"), folder, 2, 4)
    assert {r.pr_id: r.title for r in two["prs"].read().collect()} == {f"o/r#{i}": "one" if i < 2 else "two words" for i in range(6)}
    assert two["pr_files"].read().count() == 8 and two["file_deps"].read().count() == 2
    second = {r.pr_id: list(r.embedding) for r in two["pr_embeddings"].read().collect()}
    assert len(second) == 6 and all((second[k] == first[k]) == (k in ("o/r#0", "o/r#1")) for k in first)


def test_review_stream_reads_only_touched_buckets(spark, diffs_of, monkeypatch):
    """Changes of many pull requests arrive first; then one of them changes again, and compaction comes every two arrivals."""
    folder, source = new_dir(spark, "reviews"), new_dir(spark, "source")
    every = [(f"o/r#{i}", 1, f"f{i}.py", "python", "modified", 1, '+password = "hunter2"') for i in range(60)]
    more = [[("o/r#7", 2, "g.py", "python", "modified", 1, "+eval(x)"), ("o/r#7", 1, "f7.py", "python", "modified", 1, "+ok")],
            [("o/r#7", 3, "h.py", "python", "modified", 1, '+password = "hunter2"')], [("o/r#9", 1, "f9.py", "python", "modified", 1, "+fine")]]
    read = []
    real = StoredTable.versions

    def seen(self, buckets=None):
        out = real(self, buckets)
        if buckets is not None:
            read.append({f.split("_bucket=")[1].split("/")[0] for f, in out.select(F.input_file_name()).distinct().collect()})
        return out

    monkeypatch.setattr(StoredTable, "versions", seen)
    for part in [every, *more]:
        read.clear()
        df = diffs_of(*part)
        df.write.mode("append").parquet(source)
        stream = spark.readStream.schema(df.schema).parquet(source)
        sinks.review_stream(stream, folder, f"{folder}/checkpoint", buckets=8, compact_after=2).awaitTermination()
        if part is not every:
            assert read and all(len(b) == 1 for b in read)
    newest = {(r[0], r[1]): r for part in [every, *more] for r in part}
    want = rv.review(diffs_of(*newest.values()))
    columns = ["pr_id", "rank", "file_path", "line_start", "confidence"]
    got = sinks.current_reviews(spark, folder).select(*columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*columns).collect()))
    assert "o/r#9" not in {r.pr_id for r in got.collect()}


def test_a_load_makes_its_rows_once(spark, tmp_path):
    """The buckets to compact are read from the table, so the rows are worked out for the append only."""
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    table = StoredTable(spark, str(tmp_path / "once"), "k bigint, v bigint", ["k"], buckets=4)
    rows = spark.range(100).selectExpr("id % 60 AS k", "id AS v").coalesce(1).mapInArrow(counted, "k bigint, v bigint")
    table.upsert(rows, 1)
    table.upsert(rows.where("k < 10"), 2)
    assert made.value == 200
    assert table.read().count() == 60
