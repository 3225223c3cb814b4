"""History: stored pull requests, file edges, overlap, bug patterns and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revsieve.functions.languages import file_dependencies
from revsieve.functions.text import issue_refs
from revsieve.operators.ranking import top_per_key
from revsieve.operators.similarity import pr_vectors
from revsieve.plans.joins import fits
from revsieve.plans.lineage import cut

# Limits of the history look-ups.
RELATED_LIMIT = 10
CLOSED_LIMIT = 5
RECENT_LIMIT = 10
FALLBACK_LIMIT = 5
FALLBACK_SCORE = 0.5
LOOK_BACK_DAYS = 30
HOT_FILE_MIN = 3
HOT_FILE_LIMIT = 10
ISSUE_RELEVANCE = 0.7
CLOSED_RELEVANCE = 0.6
SIMILAR_EVIDENCE = 3
BUG_EVIDENCE = 2

# A file touched by more pull requests than this is hot (see ``common_file_counts``).
MAX_FILE_DEGREE = 200
PASSED_FILES = 8  # hottest files of a pull request that it is not paired on
NARROW = 10  # hot files of a pull request whose subsets are listed


def latest_versions(versions: DataFrame, key: str = "pr_id", order: tuple = ("updated_at", "version_id")) -> DataFrame:
    """Newest row per key; a hot key sends one row per task to the shuffle."""
    by = [F.col(c).desc() for c in order]
    return top_per_key(versions, [key], by, 1, "_rn").drop("_rn")


def pr_file_edges(diffs: DataFrame, prs: DataFrame | None = None, keep_removed: bool = False) -> DataFrame:
    """Distinct (pull request, file); only of known pull requests if ``prs`` is given. Dealt by pull request, so look-ups by it go on from there."""
    live = diffs if keep_removed else diffs.filter(F.col("status") != "removed")
    edges = live.select("pr_id", "file_path").repartition("pr_id").distinct()
    return edges if prs is None else edges.join(prs.select("pr_id"), "pr_id", "left_semi")


def touched_files(diffs: DataFrame) -> DataFrame:
    """Distinct (pull request, file) with whether the file is left in it (``live``): both forms of ``pr_file_edges`` from one reading."""
    live = F.coalesce(F.col("status") != "removed", F.lit(False))
    return diffs.select("pr_id", "file_path", live.alias("live")).repartition("pr_id").groupBy("pr_id", "file_path").agg(F.max("live").alias("live"))


def file_dep_edges(diffs: DataFrame, prs: DataFrame | None = None) -> DataFrame:
    """Distinct (file, file it imports) from python files that were not removed."""
    live = diffs.filter(F.col("status") != "removed")
    if prs is not None:
        live = live.join(prs.select("pr_id"), "pr_id", "left_semi")
    deps = file_dependencies(F.col("diff"), F.col("language"))
    return live.select(F.col("file_path").alias("src"), F.explode(deps).alias("dst")).distinct()


def build_history(prs: DataFrame, diffs: DataFrame) -> dict[str, DataFrame]:
    """Tables a review leaves for later ones."""
    return {
        "prs": prs,
        "pr_files": pr_file_edges(diffs, prs),
        "file_deps": file_dep_edges(diffs, prs),
        "pr_embeddings": pr_vectors(prs, diffs),
    }


# -- file overlap ---------------------------------------------------------------


def _tie(prefix: str = "") -> list[Column]:
    return [F.col(f"{prefix}pr_number").desc(), F.col(f"{prefix}pr_id").asc()]


def subsets(items: Column, most: int) -> Column:
    """All subsets of 1 to ``most`` elements, each in the order of ``items``."""
    grow = lambda known, x: F.concat(known, F.transform(
        F.filter(known, lambda s: F.size(s) < most), lambda s: F.concat(s, F.array(x))))
    none = F.array(F.array().cast("array<bigint>"))
    return F.filter(F.aggregate(items, none, grow), lambda s: F.size(s) > 0)


def own_hot_files(hot: DataFrame, passed: int) -> DataFrame:
    """(pr, over, hot): all hot files of a pull request, and its ``passed`` hottest. ``hot`` has (pr, file, degree) with numbers for both."""
    by_heat = F.transform(F.sort_array(F.collect_list(F.struct(-F.col("degree"), "file"))), lambda x: x["file"])
    return cut(hot.groupBy("pr").agg(by_heat.alias("heat")).select(
        "pr", F.sort_array(F.slice("heat", 1, passed)).alias("over"), F.sort_array("heat").alias("hot")))


def holders_of(own: DataFrame, passed: int, narrow: int) -> tuple[DataFrame, DataFrame]:
    """(files, other, other_hot) for every set of up to ``passed`` hot files that a pull request holds, and (file, other) for the few
    pull requests with more than ``narrow`` hot files, which have too many such sets."""
    few = own.where(F.size("hot") <= narrow).select(
        F.explode(subsets(F.col("hot"), passed)).alias("files"), F.col("pr").alias("other"), F.col("hot").alias("other_hot"))
    wide = own.where(F.size("hot") > narrow).select(F.explode("hot").alias("file"), F.col("pr").alias("other"))
    return few, wide


def _hot_partners(own: DataFrame, limit: int, passed: int, narrow: int) -> DataFrame:
    """(over, partners): for the files that a pull request passes over, the first ``limit + 1`` partners by how many of these they share.

    Whoever shares nothing else with it shares exactly some set X of these files; all holders of X share at least as much, so only the
    first few of them count. Subsets are many more than the sets that the planner counts, so none of them goes to the driver.
    """
    few, wide = holders_of(own, passed, narrow)
    asked = own.select("over").distinct()
    first = top_per_key(few, ["files"], [F.col("other").desc()], limit + 1, "_n").drop("_n").hint("merge")
    listed = asked.select("over", F.explode(subsets(F.col("over"), passed)).alias("files")).join(first, "files").select(
        "over", "other", F.size(F.array_intersect("over", "other_hot")).cast("bigint").alias("shared")).distinct()
    counted = asked.select("over", F.explode("over").alias("file")).join(wide.hint("merge"), "file").groupBy("over", "other").agg(F.count("*").alias("shared"))
    best = top_per_key(listed.unionByName(counted), ["over"], [F.col("shared").desc(), F.col("other").desc()], limit + 1, "_n")
    return best.groupBy("over").agg(F.collect_list(F.struct("other", "shared")).alias("partners"))


def numbered_edges(edges: DataFrame, *more: str) -> tuple[DataFrame, DataFrame]:
    """(pr, pr_id, pr_number), numbered in the order of ties, and the edges as (pr, file_path)."""
    prs = edges.select("pr_id", "pr_number", *more).distinct().orderBy("pr_number", F.col("pr_id").desc())
    named = cut(prs.withColumn("pr", F.monotonically_increasing_id()))
    return named, edges.select("pr_id", "file_path").join(named.select("pr_id", "pr"), "pr_id").select("pr", "file_path")


def hot_edges(by_file: DataFrame, max_degree: int) -> tuple[DataFrame, DataFrame]:
    """(file_path, degree, file) of hot files, the less hot ones with lower numbers, and (pr, file, degree)."""
    degree = by_file.groupBy("file_path").agg(F.count("*").alias("degree")).where(F.col("degree") > max_degree)
    files = cut(degree.orderBy("degree", "file_path").withColumn("file", F.monotonically_increasing_id()))
    return files, by_file.join(files, "file_path").select("pr", "file", "degree")


def pairing_sides(by_file: DataFrame, files: DataFrame, own: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(file_path, pr, over) without the files passed over, and (file_path, other, other_hot) with all."""
    none = F.lit(None).cast("array<bigint>")
    if own is None:
        left = by_file.withColumn("over", none)
        return left, by_file.select("file_path", F.col("pr").alias("other"), none.alias("other_hot"))
    numbered = by_file.join(files.select("file_path", "file"), "file_path", "left").join(own, "pr", "left")
    passed = F.coalesce(F.array_contains("over", F.col("file")), F.lit(False))
    return numbered.where(~passed).select("file_path", "pr", "over"), numbered.select(
        "file_path", F.col("pr").alias("other"), F.col("hot").alias("other_hot"))


def counted_pairs(met: DataFrame) -> DataFrame:
    """(pr, other, common_files) of pairs that met on files, with the files on top that were passed over."""
    more = F.when(F.col("over").isNotNull() & F.col("other_hot").isNotNull(), F.size(F.array_intersect("over", "other_hot"))).otherwise(0)
    grouped = met.select("pr", "other", more.alias("more")).groupBy("pr", "other", "more").agg(F.count("*").alias("n"))
    return grouped.select("pr", "other", (F.col("n") + F.col("more")).alias("common_files"))


def file_sets(by_file: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pr, set, n_files) and (set, file_path): pull requests with the same files share a set, which is named by the last of them."""
    files = cut(by_file.select("file_path").distinct().withColumn("file", F.monotonically_increasing_id()))
    held = by_file.join(files, "file_path", "left").groupBy("pr").agg(
        F.sort_array(F.collect_list("file")).alias("held"), F.count("*").alias("n_files"))
    held = cut(held.where(F.size("held") > 0))
    sets = cut(held.groupBy("held").agg(F.max("pr").alias("set")))
    members = held.join(sets, "held").select("pr", "set", "n_files")
    return members, sets.select("set", F.explode("held").alias("file")).join(files, "file").select("set", "file_path")


def _set_partners(by_file: DataFrame, limit: int, max_degree: int, passed: int, narrow: int) -> DataFrame:
    """(pr, other, common_files) for the ``limit`` sets that share most files with each set, ``by_file`` being (pr, file_path)."""
    files, hot = hot_edges(by_file, max_degree)
    own = None if files.isEmpty() else own_hot_files(hot, passed)
    left, other = pairing_sides(by_file, files, own)
    order = [F.col("common_files").desc(), F.col("other").desc()]
    top = top_per_key(counted_pairs(left.join(other, "file_path")), ["pr"], order, limit, "overlap_rank")
    if own is not None:
        through_hot = own.select("pr", "over").join(_hot_partners(own, limit, passed, narrow).hint("merge"), "over").select(
            "pr", F.inline("partners")).withColumnRenamed("shared", "common_files")
        top = first_of_both(top.drop("overlap_rank"), through_hot, limit)
    return top.select("pr", "other", "common_files")


def _common_files(edges: DataFrame, limit: int, max_degree: int, passed: int, narrow: int) -> DataFrame:
    """``common_file_counts`` with the number of the pull request's own files."""
    named, by_file = numbered_edges(edges)
    members, set_files = file_sets(by_file)
    partners = _set_partners(set_files.withColumnRenamed("set", "pr"), limit, max_degree, passed, narrow)
    first = top_per_key(members.select("set", "pr"), ["set"], [F.col("pr").desc()], limit, "_n").join(named, "pr").select(
        F.col("set").alias("other"), F.col("pr").alias("other_pr"), F.col("pr_id").alias("other_id"), F.col("pr_number").alias("other_number"))
    best = top_per_key(partners.withColumnRenamed("pr", "set").join(first, "other").drop("other"), ["set"],
                       [F.col("common_files").desc(), F.col("other_pr").desc()], limit, "overlap_rank")
    lists = best.groupBy("set").agg(F.collect_list(F.struct("other_id", "other_number", "common_files", "overlap_rank")).alias("found"))
    return members.join(named.select("pr", "pr_id"), "pr").join(lists.hint("merge"), "set").select("pr_id", "n_files", F.inline("found"))


def common_file_counts(
    edges: DataFrame, limit: int = RELATED_LIMIT, max_degree: int = MAX_FILE_DEGREE, passed: int = PASSED_FILES, narrow: int = NARROW,
) -> DataFrame:
    """For every pull request, the ``limit`` pull requests sharing most files with it.

    ``edges`` has (pr_id, pr_number, file_path). Ties go to the higher number. The
    pull request itself is among its candidates.

    Pull requests with the same files have the same partners, so sets of files are compared and each set brings its first ``limit`` members.

    Files in up to ``max_degree`` sets are paired directly. Of the others, hot ones (lock files, change logs), a set
    passes over its ``passed`` hottest: it is not paired on them, but partners that it meets elsewhere count them, and of those
    that it meets nowhere else it takes the first few of each group that shares the same ones. The result is exact. Only sets with more
    than ``passed`` hot files are paired on the rest of these, and only those with more than ``narrow`` met one by one on the files passed over.
    """
    return _common_files(edges, limit, max_degree, passed, narrow).drop("n_files")


def first_of_both(met: DataFrame, through_hot: DataFrame, limit: int) -> DataFrame:
    """A pair on both lists counts as on the one with more files."""
    both = met.unionByName(through_hot).groupBy("pr", "other").agg(F.max("common_files").alias("common_files"))
    return top_per_key(both, ["pr"], [F.col("common_files").desc(), F.col("other").desc()], limit, "overlap_rank")


def same_repo(pr_id: Column, other_id: Column) -> Column:
    return F.substring_index(pr_id, "#", 1) == F.substring_index(other_id, "#", 1)


def related_by_files(edges: DataFrame, limit: int = RELATED_LIMIT,
                     max_degree: int = MAX_FILE_DEGREE) -> DataFrame:
    """Overlapping pull requests of the same repository.

    The limit comes before the repository filter: pull requests of other
    repositories that touch equal paths use up places.
    """
    top = _common_files(edges, limit, max_degree, PASSED_FILES, NARROW)
    return (
        top.filter(same_repo(F.col("pr_id"), F.col("other_id")) & (F.col("pr_id") != F.col("other_id")))
        .select(
            "pr_id", "other_id", "other_number", "common_files", "overlap_rank",
            (F.col("common_files") / F.col("n_files")).alias("similarity_score"),
        )
    )


# -- recent pull requests ---------------------------------------------------------


def recent_in_repo(prs: DataFrame, as_of: Column, days: int = LOOK_BACK_DAYS,
                   limit: int = RECENT_LIMIT) -> DataFrame:
    """Newest pull requests of the same repository within the look-back up to ``as_of``, not itself.

    A repository's newest ``limit + 1`` rows serve all its pull requests, so
    no two pull requests are compared.
    """
    recent = prs.filter(
        (F.col("created_at") >= as_of - F.make_dt_interval(F.lit(days))) & (F.col("created_at") <= as_of))
    newest = [F.col("created_at").desc(), *_tie()]
    repo = ["repo_owner", "repo_name"]
    lists = (
        top_per_key(recent.select(*repo, "pr_id", "pr_number", "created_at"), repo, newest, limit + 1, "rank")
        .groupBy(*repo)
        .agg(F.sort_array(F.collect_list(F.struct(
            "rank", F.col("pr_id").alias("other_id"), F.col("pr_number").alias("other_number")
        ))).alias("recent"))
    )
    own = F.filter("recent", lambda r: r["other_id"] != F.col("pr_id"))
    return (
        prs.select("pr_id", *repo)
        .join(lists, repo)
        .select("pr_id", F.posexplode(F.slice(own, 1, limit)).alias("pos", "r"))
        .select("pr_id", "r.other_id", "r.other_number",
                (F.col("pos") + 1).cast("int").alias("recent_rank"))
    )


# -- merge of similarity methods ----------------------------------------------------


def merge_similar(prs: DataFrame, overlap: DataFrame, vectors: DataFrame | None = None,
                  recent: DataFrame | None = None, limit: int = RELATED_LIMIT) -> DataFrame:
    """Similar pull requests from all methods, first method wins, best ``limit`` kept.

    Inputs have (pr_id, other_id, other_number, similarity_score, method_rank).
    ``recent`` only serves pull requests the other methods found nothing for.
    """
    cols = ["pr_id", "other_id", "other_number", "similarity_score", "method_rank"]
    sources = [(vectors, 1, "vector_search", F.lit("Code similarity")),
               (overlap, 2, "file_overlap", None)]
    parts = []
    for df, order, method, reason in sources:
        if df is None:
            continue
        if reason is None:
            reason = F.concat(F.lit("Modified "), F.col("common_files").cast("string"), F.lit(" common files"))
        parts.append(df.select(
            *cols, F.lit(order).alias("method_ord"), F.lit(method).alias("method"),
            reason.alias("reason"),
        ))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    if recent is not None:
        fallback = (
            recent.filter(F.col("recent_rank") <= FALLBACK_LIMIT)
            .join(found.select("pr_id").distinct(), "pr_id", "left_anti")
            .select(
                "pr_id", "other_id", "other_number",
                F.lit(FALLBACK_SCORE).alias("similarity_score"),
                F.col("recent_rank").alias("method_rank"),
                F.lit(3).alias("method_ord"), F.lit("recent").alias("method"),
                F.lit("Recent PRs in same repo").alias("reason"),
            )
        )
        found = found.unionByName(fallback)
    first = top_per_key(  # the few rows of a pull request are dealt once for both rankings
        found.repartition("pr_id"), ["pr_id", "other_number"], [F.col("method_ord"), F.col("method_rank")], 1, "_rn"
    ).drop("_rn")
    order = [F.col("similarity_score").desc(), F.col("method_ord"), F.col("method_rank")]
    return top_per_key(first, ["pr_id"], order, limit, "similar_rank")


# -- bug patterns -------------------------------------------------------------------


def related_issues(prs: DataFrame, issues: DataFrame, by_repo: bool = True) -> DataFrame:
    """Issues named in the description, in order; unknown numbers drop out, repeats stay.

    Many descriptions name the same issue. While the issues that are named at all are few, they go to every
    task, so no task gets all descriptions that name one.
    """
    refs = prs.select(
        "pr_id", "repo_owner", "repo_name",
        F.posexplode(issue_refs(F.col("description"))).alias("ref_ord", "issue_id"),
    )
    on = ["issue_id", "repo_owner", "repo_name"] if by_repo else ["issue_id"]
    if not by_repo:
        refs = refs.drop("repo_owner", "repo_name")
    named = issues.join(cut(refs.select(*on).distinct()), on, "left_semi")
    return refs.join(F.broadcast(named) if fits(named) else named, on)


def bug_issues(related: DataFrame) -> DataFrame:
    hit = F.array_contains("labels", "bug") | F.lower("title").contains("error")
    return related.filter(hit).select(
        "pr_id", "ref_ord", "issue_id", "title",
        F.lit("bug_report").alias("pattern"), F.lit(ISSUE_RELEVANCE).alias("relevance"),
        F.lit("related_issue").alias("source"),
    )


def closed_on_same_files(touched: DataFrame, edges: DataFrame, prs: DataFrame,
                         limit: int = CLOSED_LIMIT) -> DataFrame:
    """Closed pull requests on the same files, newest number first.

    Only the first ``limit`` closed pull requests of a file can be among the first
    ``limit`` of anyone touching it, so each file keeps just those and no file
    pairs all its pull requests.
    """
    closed = prs.filter(F.col("state") == "closed").select("pr_id", "pr_number", "title")
    per_file = top_per_key(
        edges.select("pr_id", "file_path").join(closed, "pr_id"),
        ["file_path"], _tie(), limit, "_rn",
    )
    lists = per_file.groupBy("file_path").agg(
        F.collect_list(F.struct(
            F.col("pr_id").alias("other_id"), F.col("pr_number").alias("other_number"),
            F.col("title").alias("title"),
        )).alias("closed")
    )
    lists = cut(lists)
    held = touched.select("pr_id", "file_path")
    # few lists go to every task; the files of a pull request lie together (``pr_file_edges``), so what the lists hold is not shuffled
    met = held.join(F.broadcast(lists), "file_path") if fits(lists) else held.join(lists, "file_path")
    found = met.select("pr_id", F.inline("closed")).distinct()
    order = [F.col("other_number").desc(), F.col("other_id").asc()]
    return top_per_key(found, ["pr_id"], order, limit, "bug_rank").select(
        "pr_id", "other_id", "other_number", "title", "bug_rank",
        F.lit("historical_bug").alias("pattern"), F.lit(CLOSED_RELEVANCE).alias("relevance"),
        F.lit("history").alias("source"),
    )


def hot_files(edges: DataFrame, prs: DataFrame, min_count: int = HOT_FILE_MIN,
              limit: int = HOT_FILE_LIMIT) -> DataFrame:
    counts = (
        edges.select("pr_id", "file_path")
        .join(prs.select("pr_id", "repo_owner", "repo_name"), "pr_id")
        .groupBy("repo_owner", "repo_name", "file_path")
        .agg(F.count("*").alias("modification_count"))
        .filter(F.col("modification_count") > min_count)
    )
    order = [F.col("modification_count").desc(), F.col("file_path").asc()]
    return top_per_key(counts, ["repo_owner", "repo_name"], order, limit, "hot_rank")


# -- evidence -------------------------------------------------------------------------


def evidence(similar: DataFrame | None, issues: DataFrame | None, closed: DataFrame | None) -> DataFrame:
    """Per pull request the lines shown under its findings: similar first, then bugs."""
    lines = []
    if similar is not None:
        lines.append(similar.filter(F.col("similar_rank") <= SIMILAR_EVIDENCE).select(
            "pr_id", F.lit(0).alias("part"), F.col("similar_rank").cast("int").alias("ord"),
            F.format_string(
                "Similar pattern in PR #%s (similarity: %.2f, method: %s)",
                F.col("other_number").cast("string"), "similarity_score", "method",
            ).alias("line"),
        ))
    bugs = []
    if issues is not None:
        bugs.append(top_per_key(issues, ["pr_id"], [F.col("ref_ord")], BUG_EVIDENCE, "_rn").select(
            "pr_id", F.lit(1).alias("part"), F.col("_rn").alias("ord"),
            F.concat(F.lit("Related to issue #"), "issue_id", F.lit(": "), "title").alias("line"),
        ))
    if closed is not None:
        bugs.append(closed.filter(F.col("bug_rank") <= BUG_EVIDENCE).select(
            "pr_id", F.lit(2).alias("part"), F.col("bug_rank").alias("ord"),
            F.concat(
                F.lit("Similar files modified in PR #"), F.col("other_number").cast("string"),
                F.lit(": "), "title",
            ).alias("line"),
        ))
    if bugs:
        both = bugs[0] if len(bugs) == 1 else bugs[0].unionByName(bugs[1])
        lines.append(
            top_per_key(both, ["pr_id"], [F.col("part"), F.col("ord")], BUG_EVIDENCE, "_rn").drop("_rn")
        )
    every = lines[0]
    for more in lines[1:]:
        every = every.unionByName(more)
    ordered = F.sort_array(F.collect_list(F.struct("part", "ord", "line")))
    return every.groupBy("pr_id").agg(F.transform(ordered, lambda s: s["line"]).alias("evidence"))
