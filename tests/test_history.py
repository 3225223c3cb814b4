import itertools
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from revsieve.operators import cycles, history as hist, ranking, report, similarity as sim
from revsieve.operators.ranking import top_per_key


def _edges(rng, n_prs, hot_share):
    edges = set()
    for p in range(n_prs):
        for _ in range(rng.randint(1, 4)):
            edges.add((f"o/r{p % 3}#{p}", p, f"f{rng.randint(0, 40)}"))
        if rng.random() < hot_share:
            edges.add((f"o/r{p % 3}#{p}", p, "package.lock"))
        if rng.random() < hot_share / 2:
            edges.add((f"o/r{p % 3}#{p}", p, "CHANGES"))
    return sorted(edges)


def _brute(edges, limit):
    files = defaultdict(set)
    number = {}
    for pr, n, f in edges:
        files[pr].add(f)
        number[pr] = n
    out = set()
    for q in files:
        scored = [(-len(files[q] & files[p]), -number[p], p) for p in files if files[q] & files[p]]
        for rank, (c, n, p) in enumerate(sorted(scored)[:limit], 1):
            out.add((q, p, -c, rank))
    return out


def test_common_files_equal_all_pairs_for_any_degree_limit(spark):
    edges = _edges(random.Random(1), 80, 0.7)
    df = spark.createDataFrame(edges, "pr_id string, pr_number bigint, file_path string")
    want = _brute(edges, 10)
    for max_degree in (0, 5, 30, 1000):
        got = {(r.pr_id, r.other_id, r.common_files, r.overlap_rank)
               for r in hist.common_file_counts(df, 10, max_degree).collect()}
        assert got == want, max_degree


def test_subsets_of_hot_files_are_not_broadcast(spark):
    """The planner counts the sets, not their many subsets, which would all go to the driver."""
    own = spark.range(3).selectExpr("id AS pr", "sequence(0L, 7L) AS over", "sequence(0L, 7L) AS hot")
    plan = hist._hot_partners(own, 10, 8, 10)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" in plan and "Broadcast" not in plan


def test_common_counts_are_symmetric_without_a_limit(spark):
    edges = _edges(random.Random(2), 30, 0.5)
    df = spark.createDataFrame(edges, "pr_id string, pr_number bigint, file_path string")
    got = {(r.pr_id, r.other_id): r.common_files for r in hist.common_file_counts(df, 1000, 6).collect()}
    assert all(got[b, a] == n for (a, b), n in got.items())


@pytest.mark.parametrize("passed,narrow", [(1, 16), (2, 2), (3, 16), (4, 0)])
def test_common_counts_with_few_files_passed_over(spark, passed, narrow):
    edges = _edges(random.Random(passed), 40, 0.4)
    files, number = defaultdict(set), {}
    for pr, n, f in edges:
        files[pr].add(f)
        number[pr] = n
    want = set()
    for q in files:
        shared = sorted(((-len(files[q] & files[o]), -number[o], o) for o in files if files[q] & files[o]))[:5]
        want |= {(q, o, -n, k) for k, (n, _, o) in enumerate(shared, 1)}
    df = spark.createDataFrame(edges, "pr_id string, pr_number bigint, file_path string")
    for max_degree in (3, 12):
        got = {(r.pr_id, r.other_id, r.common_files, r.overlap_rank)
               for r in hist.common_file_counts(df, 5, max_degree, passed, narrow).collect()}
        assert got == want, max_degree


def test_a_file_of_all_with_as_many_sets(spark):
    """30,000 pull requests on one file, each with its own three of 60 others that are hot too: no sets or users are paired."""
    n, others = 30_000, 60
    combos = list(itertools.islice(itertools.combinations(range(others), 3), n))
    rows = [(f"o/r#{i}", i, f) for i, c in enumerate(combos) for f in ("lock", *(f"h{k}" for k in c))]
    df = spark.createDataFrame(rows, "pr_id string, pr_number bigint, file_path string")
    top = hist.common_file_counts(df, 4).where("pr_id in ('o/r#0', 'o/r#17', 'o/r#29999')").collect()
    for q in (0, 17, 29_999):
        shared = sorted(((1 + len(set(c) & set(combos[q])), i) for i, c in enumerate(combos)), reverse=True)[:4]
        got = sorted((r for r in top if r.pr_id == f"o/r#{q}"), key=lambda r: r.overlap_rank)
        assert [(r.common_files, r.other_number) for r in got] == shared


def test_hot_file_does_not_pair_everything(spark):
    """A file in every pull request: work stays linear in the number of rows."""
    df = spark.range(3000).select(
        F.concat(F.lit("o/r#"), F.col("id")).alias("pr_id"), F.col("id").alias("pr_number"),
        F.lit("package.lock").alias("file_path"))
    got = hist.common_file_counts(df, 10)
    assert got.count() == 30000
    assert {r.other_number for r in got.select("other_number").distinct().collect()} == set(range(2990, 3000))


@pytest.mark.parametrize("same", [True, False])
def test_six_hot_files_of_all_pair_no_pull_requests(spark, monkeypatch, same):
    """Equal sets count as one, and sets of up to eight hot files are not paired on any of them."""
    rng = random.Random(5)
    edges = [(f"o/r#{p}", p, f"f{f}") for p in range(400) for f in (range(6) if same else rng.sample(range(12), 6))]
    met = []
    counted = hist.counted_pairs
    monkeypatch.setattr(hist, "counted_pairs", lambda df: (met.append(df.count()), counted(df))[1])
    df = spark.createDataFrame(edges, "pr_id string, pr_number bigint, file_path string")
    got = {(r.pr_id, r.other_id, r.common_files, r.overlap_rank) for r in hist.common_file_counts(df, 10, 20).collect()}
    assert got == _brute(edges, 10)
    assert met[0] <= 400


def test_closed_prs_equal_a_plain_loop(spark):
    rng = random.Random(4)
    edges = _edges(rng, 60, 0.6)
    state = {n: rng.choice(["open", "closed"]) for _, n, _ in edges}
    df = spark.createDataFrame(edges, "pr_id string, pr_number bigint, file_path string")
    prs = df.select("pr_id", "pr_number").distinct().withColumn(
        "state", F.when(F.col("pr_number").isin([n for n in state if state[n] == "closed"]), "closed").otherwise("open")
    ).withColumn("title", F.lit("t"))
    got = defaultdict(list)
    for r in hist.closed_on_same_files(df, df, prs).orderBy("bug_rank").collect():
        got[r.pr_id].append(r.other_number)
    files = defaultdict(set)
    for pr, n, f in edges:
        files[pr].add(f)
    ids = {pr: n for pr, n, _ in edges}
    for q in files:
        want = sorted((ids[p] for p in files if files[p] & files[q] and state[ids[p]] == "closed"), reverse=True)[:5]
        assert got[q] == want


def test_recent_skips_itself_and_keeps_ten(spark):
    prs = spark.range(30).select(
        F.concat(F.lit("o/r#"), F.col("id")).alias("pr_id"), F.col("id").alias("pr_number"),
        F.lit("o").alias("repo_owner"), F.lit("r").alias("repo_name"),
        F.expr("timestamp '2024-01-01' + make_dt_interval(id)").alias("created_at"))
    got = defaultdict(list)
    for r in hist.recent_in_repo(prs, F.lit("2024-01-30").cast("timestamp"), 30).orderBy("recent_rank").collect():
        got[r.pr_id].append(r.other_number)
    assert got["o/r#29"] == list(range(28, 18, -1))
    assert got["o/r#0"] == list(range(29, 19, -1))


def test_merge_keeps_first_method_and_fallback_only_when_empty(spark):
    cols = "pr_id string, other_id string, other_number bigint, similarity_score double, method_rank int"
    vec = spark.createDataFrame([("q", "a", 1, 0.6, 1)], cols)
    over = spark.createDataFrame([("q", "a", 1, 0.9, 1, 2), ("q", "b", 2, 0.8, 2, 2)], cols + ", common_files bigint")
    recent = spark.createDataFrame([("q", "c", 3, 1), ("z", "c", 3, 1), ("z", "d", 4, 6)],
                                   "pr_id string, other_id string, other_number bigint, recent_rank int")
    rows = hist.merge_similar(None, over, vec, recent).orderBy("pr_id", "similar_rank").collect()
    assert [(r.pr_id, r.other_id, r.similarity_score, r.method) for r in rows] == [
        ("q", "b", 0.8, "file_overlap"), ("q", "a", 0.6, "vector_search"), ("z", "c", 0.5, "recent")]


def _trails(edges, limit):
    out = defaultdict(list)
    nexts = defaultdict(list)
    for s, d in edges:
        nexts[s].append(d)

    def walk(start, at, path, used):
        for d in nexts[at]:
            if (at, d) not in used:
                if d == start:
                    out[start].append(path + [d])
                walk(start, d, path + [d], used | {(at, d)})

    for s in list(nexts):
        walk(s, s, [s], frozenset())
    return {s: sorted(ps, key=lambda p: (len(p), " > ".join(p)))[:limit] for s, ps in out.items()}


def test_cycles_equal_all_trails(spark):
    edges = {("a", "b"), ("b", "c"), ("c", "a"), ("b", "a"), ("c", "d"), ("e", "a"), ("f", "f"), ("d", "c"), ("g", "h")}
    df = spark.createDataFrame(sorted(edges), "src string, dst string")
    for limit in (2, 10):
        got = defaultdict(list)
        for r in cycles.import_cycles(df, limit).orderBy("start", "cycle_rank").collect():
            got[r.start].append(r.path)
        assert dict(got) == _trails(edges, limit)


def test_no_cycles(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    assert cycles.import_cycles(df).count() == 0


def test_vectors_with_copies_equal_all_pairs(spark):
    rng = random.Random(9)
    base = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(40)]
    vecs = [(f"p{i}", i, "hot" if i % 3 else f"b{i % 2}", base[0] if i % 4 == 0 else base[i % 40]) for i in range(150)]
    vecs.append(("zero", 999, "hot", [0.0] * 8))
    df = spark.createDataFrame(vecs, "pr_id string, pr_number bigint, block string, embedding array<double>")

    def cos(a, b):
        n = lambda v: sum(x * x for x in v) ** 0.5 + 1e-8
        return round(max(-1.0, min(1.0, sum(x * y for x, y in zip(a, b)) / (n(a) * n(b)))), 6)

    want = set()
    for p, _, b, v in vecs:
        near = [(-cos(v, w), -n, o) for o, n, c, w in vecs if c == b and o != p and cos(v, w) >= 0.6]
        want |= {(p, o, -s, k) for k, (s, _, o) in enumerate(sorted(near)[:10], 1)}
    for tile in (2048, 15, 4):
        got = {(r.pr_id, r.other_id, r.similarity_score, r.method_rank) for r in sim.vector_top_k(df, 0.6, tile=tile).collect()}
        assert got == want, tile


def test_embedding_is_deterministic_and_unit(spark):
    df = spark.createDataFrame([("p", "Title: fix login bug"), ("q", "Title: fix login bug"), ("r", "")], "pr_id string, text string")
    rows = {r.pr_id: r.embedding for r in sim.embed(df).collect()}
    assert rows["p"] == rows["q"] and len(rows["p"]) == 384
    assert abs(sum(x * x for x in rows["p"]) - 1) < 1e-5 and sum(rows["r"]) == 0


def test_evidence_order(spark):
    similar = spark.createDataFrame(
        [("q", "a", 1, 0.125, "vector_search", 1)],
        "pr_id string, other_id string, other_number bigint, similarity_score double, method string, similar_rank int")
    issues = spark.createDataFrame([("q", 0, "7", "Error x")], "pr_id string, ref_ord int, issue_id string, title string")
    closed = spark.createDataFrame(
        [("q", "c", 3, "T", 1), ("q", "d", 4, "U", 2)],
        "pr_id string, other_id string, other_number bigint, title string, bug_rank int")
    assert hist.evidence(similar, issues, closed).first().evidence == [
        "Similar pattern in PR #1 (similarity: 0.13, method: vector_search)",
        "Related to issue #7: Error x", "Similar files modified in PR #3: T"]


def test_files_of_the_history_are_read_once(spark, monkeypatch):
    """Files with and without the removed ones come from one reading; the rankings of similar pull requests share one shuffle."""
    from revsieve.plans import review as rv

    rows = [("p", "a", "added"), ("p", "a", "removed"), ("p", "b", "removed"), ("p", "c", None), ("q", "a", "modified"), ("q", "a", "added")]
    diffs = spark.createDataFrame(rows, "pr_id string, file_path string, status string")
    both = hist.touched_files(diffs)
    pairs = lambda df: sorted((r.pr_id, r.file_path) for r in df.collect())
    assert pairs(both) == pairs(hist.pr_file_edges(diffs, keep_removed=True))
    assert pairs(both.where("live")) == pairs(hist.pr_file_edges(diffs)) == [("p", "a"), ("q", "a")]
    read = []
    monkeypatch.setattr(hist, "pr_file_edges", lambda *a, **k: read.append(a))
    prs = spark.createDataFrame([(f"o/r#{i}", i, "o", "r", "t", "closed", i) for i in range(3)],
                                "pr_id string, pr_number long, repo_owner string, repo_name string, title string, state string, day int")
    prs = prs.withColumn("created_at", F.timestamp_seconds(F.col("day") * 86400)).drop("day")
    diffs = spark.createDataFrame([(f"o/r#{i}", "f", "added", "") for i in range(3)], "pr_id string, file_path string, status string, diff string")
    found = rv.context(prs, diffs, F.timestamp_seconds(F.lit(3 * 86400)))
    assert read == []
    assert sorted((r.pr_id, r.other_number) for r in found["closed"].collect()) == [(f"o/r#{i}", j) for i in range(3) for j in range(3)]
    overlap = spark.createDataFrame([("p", "q", 1, 0.5, 1, 2)], "pr_id string, other_id string, other_number long, similarity_score double, method_rank int, common_files int")
    plan = hist.merge_similar(prs, overlap)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1, plan


def test_latest_version(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 3, 2), ("a", 2, 3), ("b", 1, 4)], "pr_id string, updated_at int, version_id int")
    assert {(r.pr_id, r.version_id) for r in hist.latest_versions(df).collect()} == {("a", 2), ("b", 4)}


def test_top_per_key_limits_before_the_shuffle(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 2)
    out = top_per_key(df, ["k"], [F.col("id")], 3, "rn")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert [r.id for r in out.filter("k = 0").orderBy("rn").collect()] == [0, 2, 4]


def test_large_commits_and_documents_span_parts_and_stay_whole(spark):
    files = spark.range(500).select(
        F.lit("p").alias("pr_id"), F.lit("s").alias("sha"), F.concat(F.lit("f"), F.col("id")).alias("filename"))
    parts = report.commit_file_lists(files, part_size=50, fan_out=16).collect()
    assert len(parts) == 16 and sorted(f for r in parts for f in r.files_changed) == sorted(f"f{i}" for i in range(500))
    diffs = spark.range(1, 26).select(
        F.lit("p").alias("pr_id"), F.col("id").cast("int").alias("file_ord"), F.concat(F.lit("f"), F.col("id")).alias("file_path"),
        F.lit(1).alias("additions"), F.lit(1).alias("deletions"), F.lit(2).alias("changes"), F.lit("").alias("diff"),
        F.lit("added").alias("status"), F.lit("go").alias("language"))
    prs = spark.createDataFrame([("p",), ("empty",)], "pr_id string")
    docs = report.pr_documents(prs, diffs, part_size=10).collect()
    assert sorted((r.pr_id, r.part, len(r.diffs)) for r in docs) == [("empty", 0, 0), ("p", 0, 10), ("p", 1, 10), ("p", 2, 5)]


def test_files_of_a_large_commit_are_consecutive_parts(spark):
    names = sorted(f"f{i}" for i in range(2500))
    files = spark.range(2503).select(
        F.lit("p").alias("pr_id"), F.when(F.col("id") < 2500, "large").otherwise("small").alias("sha"), F.concat(F.lit("f"), F.col("id")).alias("filename"))
    got = {(r.sha, r.part): r.files_changed for r in report.commit_file_lists(files.repartition(5)).collect()}
    assert got == {("large", 0): names[:1000], ("large", 1): names[1000:2000], ("large", 2): names[2000:], ("small", 0): ["f2500", "f2501", "f2502"]}


def test_rank_invariants(spark):
    from checks import inputs
    from revsieve.plans import review as rv
    from tests.conftest import SMALL

    ranked = rv.review(inputs.table(spark, SMALL, "file_diffs"), settings=rv.ReviewSettings(max_results=5))
    rows = ranked.collect()
    assert max(Counter(r.pr_id for r in rows).values()) <= 5
    book = rv.ReviewSettings().book()
    keys = [(r.pr_id, r.file_path, r.line_start, book.rules[r.rule_no - 1].category, book.rules[r.rule_no - 1].title[:50]) for r in rows]
    assert len(keys) == len(set(keys)) and all(0 <= r.confidence <= 1 for r in rows)
    assert ranking.MAX_RESULTS == 50


def test_documents_are_cut_by_bytes(spark):
    """A pull request of 300 files, one of them above a part's size, beside small ones."""
    sizes = [10] * 100 + [5000] + [200] * 199
    rows = [("big", i, f"f{i}", "x" * n) for i, n in enumerate(sizes, 1)] + [(f"p{i}", 1, "f", "y") for i in range(20)] + [("none", 1, None, None)]
    df = spark.createDataFrame(rows, "pr_id string, file_ord int, file_path string, diff string").repartition(6)
    got = report.listed(df, ["pr_id"], ["file_ord"], ["file_path", "diff"], "files", 100, 4000).collect()
    assert sum(len(r.files) for r in got) == len(rows)
    big = sorted((r for r in got if r.pr_id == "big"), key=lambda r: r.part)
    assert [f.file_ord for r in big for f in r.files] == list(range(1, 301))
    for r in big:
        assert len(r.files) <= 100 and sum(32 + len(f.file_path) + len(f.diff) for f in r.files[:-1]) <= 4000
    assert len(big) > 10 and all(r.part == 0 for r in got if r.pr_id != "big")


def test_parts_of_lists_are_neither_repeated_nor_sent_through_the_driver(spark):
    """20,001 or more numbered rows in several parts: each meets its part by key, without copies for salts."""
    rows = spark.range(21_000).select(F.concat(F.lit("p"), (F.col("id") % 7000).cast("string")).alias("pr_id"), F.col("id").cast("int").alias("file_ord"),
                                      F.repeat(F.lit("x"), 60).alias("file_path"))
    nested = report.listed(rows, ["pr_id"], ["file_ord"], ["file_path"], "files", part_bytes=100)
    plan = nested._jdf.queryExecution().executedPlan().toString()
    assert "_salt" not in plan and "BroadcastHashJoin" not in plan
    assert nested.agg(F.sum(F.size("files"))).first()[0] == 21_000 and nested.count() > 7000


def test_issues_that_many_name_go_to_every_task(spark):
    """Whatever Spark guesses of the sizes, the few issues that are named at all are broadcast; unknown ones drop out, repeats stay."""
    prs = spark.createDataFrame([("p", "o", "n", "#1 and #2 and #1 and #9"), ("q", "o", "n", "#1"), ("r", "o", "n", None)],
                                "pr_id string, repo_owner string, repo_name string, description string")
    issues = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c")], "issue_id string, title string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        found = hist.related_issues(prs, issues, by_repo=False)
        assert "BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()
        assert sorted((r.pr_id, r.ref_ord, r.title) for r in found.collect()) == [("p", 0, "a"), ("p", 1, "b"), ("p", 2, "a"), ("q", 0, "a")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
