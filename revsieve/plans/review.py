"""The whole review: all pull requests in, ranked findings with evidence out."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revsieve.operators import feedback as fb
from revsieve.operators import history as hist
from revsieve.operators import history_as_of as past
from revsieve.operators import similarity as sim
from revsieve.operators import vector_index as vi
from revsieve.operators.catalog import ANALYZER_FLOORS, MAX_FEEDBACK_LIFT, Rule, RuleBook
from revsieve.operators.ranking import MAX_RESULTS, MIN_CONFIDENCE, rank_findings
from revsieve.operators.relational import missing_tests
from revsieve.operators.scan import CIRCULAR, pair_imports, scan
from revsieve.plans.analyzers import Analyzer, run_analyzers
from revsieve.plans.lineage import cut, stored


@dataclass
class ReviewSettings:
    min_confidence: float = MIN_CONFIDENCE
    max_results: int = MAX_RESULTS
    strict_tests: bool = False
    normalize_imports: bool = False
    custom_rules: list[Rule] = field(default_factory=list)
    extra_analyzers: list = field(default_factory=list)  # DataFrame -> slim findings
    analyzers: list[Analyzer] = field(default_factory=list)  # with rules of their own
    learned_patterns: DataFrame | None = None  # multiply the confidence of what they cover
    category_adjustments: DataFrame | None = None  # multiply the confidence of a category
    failed: list[tuple[str, str]] = field(default_factory=list)  # (analyzer, reason) of the last review

    def book(self, spark=None) -> RuleBook:
        """The rules in force; with a session, custom rules that it can't run are left out."""
        rules = check_patterns(spark, self.custom_rules) if spark else self.custom_rules
        book = RuleBook.builtin()
        book = book.with_line_rules(rules) if rules else book
        for a in self.analyzers:
            book = book.with_analyzer(a.name, a.rules, a.floor)
        return book


def rejected_rules(spark, rules: list[Rule]) -> list[tuple[Rule, str]]:
    """Rules whose pattern the regex engine does not accept, each with the reason."""
    def tried(some: list[Rule]) -> None:
        spark.range(1).select(*(F.rlike(F.lit(""), F.lit(rule.pattern)) for rule in some)).collect()

    try:
        if rules:
            tried(rules)
        return []
    except Exception:  # noqa: BLE001  (one of them at least; now one by one)
        rejected = []
    for rule in rules:
        try:
            tried([rule])
        except Exception as error:  # noqa: BLE001  (whatever the engine says is the reason)
            rejected.append((rule, str(error).splitlines()[0]))
    return rejected


def check_patterns(spark, rules: list[Rule]) -> list[Rule]:
    """Rules whose pattern the regex engine accepts; each other one is reported as a warning."""
    rejected = rejected_rules(spark, rules)
    for rule, reason in rejected:
        warnings.warn(f"rule {rule.rule_id} is left out: {reason}", stacklevel=2)
    bad = {id(rule) for rule, _ in rejected}
    return [rule for rule in rules if id(rule) not in bad]


def all_findings(diffs: DataFrame, book: RuleBook, numbers: list[int] | None = None,
                 strict_tests: bool = False, normalize_imports: bool = False,
                 extra_analyzers: list | None = None, own: list[DataFrame] = ()) -> DataFrame:
    """Slim findings of every analyzer: one scan of the texts, one of the paths, and ``own`` ones ready made."""
    numbers = book.numbers() if numbers is None else numbers
    tests_no = book.by_id["missing_tests"]
    in_scan = [n for n in numbers if n != tests_no and book.rules[n - 1].analyzer in ANALYZER_FLOORS]
    parts = [scan(diffs, book, in_scan, normalize_imports)] if in_scan else []
    if tests_no in numbers:
        parts.append(missing_tests(diffs, book, strict_tests))
    if book.by_id[CIRCULAR] in in_scan:  # with the others beside it, as its shuffle serves the ranking too
        parts = [pair_imports(reduce(DataFrame.unionByName, parts), book)]
    parts += [*(analyze(diffs) for analyze in extra_analyzers or []), *own]
    return reduce(DataFrame.unionByName, parts)


#: What tells a finding from all others.
FINDING_KEY = ["pr_id", "file_ord", "file_path", "rule_no", "line_start", "match_ord"]


def learn(findings: DataFrame, book: RuleBook, feedback_stats: DataFrame | None,
          patterns: DataFrame | None = None, categories: DataFrame | None = None) -> DataFrame:
    """Confidence after feedback on the finding itself, then after learned patterns, then after its category's record."""
    out = findings
    if feedback_stats is not None:
        out = fb.adjust_findings(out, feedback_stats, book.finding_id()).drop("total_feedback", "positive_ratio")
    if patterns is not None or categories is not None:
        out = out.withColumn("category", book.lookup("category"))
        out = out if patterns is None else fb.apply_patterns(out, patterns, FINDING_KEY)
        out = out if categories is None else fb.apply_category_multipliers(out, categories)
        out = out.drop("category")
    return out


def review(diffs: DataFrame, feedback_stats: DataFrame | None = None,
           settings: ReviewSettings | None = None, book: RuleBook | None = None) -> DataFrame:
    """Ranked slim findings per pull request.

    Rules whose constant confidence cannot reach the threshold, even with the most
    favourable feedback, are not evaluated at all. Learned patterns and category
    records multiply, so with them every rule above its analyzer's floor is.
    """
    settings = settings or ReviewSettings()
    book = book or settings.book(diffs.sparkSession)
    lift = MAX_FEEDBACK_LIFT + 1e-9 if feedback_stats is not None else 0.0
    multiplied = settings.learned_patterns is not None or settings.category_adjustments is not None
    numbers = book.numbers(0.0 if multiplied else settings.min_confidence - lift)
    own, settings.failed = run_analyzers(diffs, settings.analyzers, book, numbers)
    found = all_findings(diffs, book, numbers, settings.strict_tests,
                         settings.normalize_imports, settings.extra_analyzers, own)
    learned = learn(found, book, feedback_stats, settings.learned_patterns, settings.category_adjustments)
    return rank_findings(learned, book, settings.min_confidence, settings.max_results)


def context(prs: DataFrame, diffs: DataFrame, as_of: Column | None, issues: DataFrame | None = None,
            vectors: DataFrame | None = None, vector_threshold: float = sim.SIMILARITY_THRESHOLD,
            days: int = hist.LOOK_BACK_DAYS, issues_by_repo: bool = True,
            text_vectors: bool = False, vector_index: str | None = None) -> dict[str, DataFrame]:
    """Everything history says about the pull requests at hand.

    With ``as_of`` every pull request sees the history stored up to that time; without it, each sees what was created before
    itself. Without given ``vectors``, ``text_vectors`` makes them of the pull requests' texts. ``vector_index`` names a stored index
    to search instead of all vectors.
    """
    if vectors is None and text_vectors:
        vectors = stored(sim.pr_vectors(prs, diffs))  # made once for the several passes of the search
    near = None
    if vectors is not None:
        near = (sim.vector_top_k(vectors, vector_threshold) if vector_index is None
                else vi.search(prs.sparkSession, vector_index, vectors, vector_threshold))
    numbered = prs.select("pr_id", "pr_number", *(["created_at"] if as_of is None else []))
    # the narrow tables serve several look-ups: write them once instead of
    # deriving them from the diffs for each of them
    files = cut(hist.touched_files(diffs))
    touched = files.select("pr_id", "file_path").repartition("pr_id")  # dealt as ``pr_file_edges`` are
    edges = cut(files.where("live").select("pr_id", "file_path").join(numbered, "pr_id"))
    if as_of is None:
        overlap, recent, closed = past.related_as_of(edges), past.recent_as_of(prs, days), past.closed_as_of(touched, edges, prs)
    else:
        overlap, recent = hist.related_by_files(edges), hist.recent_in_repo(prs, as_of, days)
        closed = hist.closed_on_same_files(touched, edges, prs)
    similar = hist.merge_similar(prs, overlap.withColumnRenamed("overlap_rank", "method_rank"), near, recent)
    out = {"similar": similar, "closed": closed, "hot_files": hist.hot_files(edges, prs)}
    if issues is not None:
        out["issues"] = hist.bug_issues(hist.related_issues(prs, issues, issues_by_repo))
    return out


def with_evidence(ranked: DataFrame, book: RuleBook, found: dict[str, DataFrame]) -> DataFrame:
    """Texts and evidence for findings that survived the ranking.

    Evidence does not change a rank, so it joins at most ``max_results`` rows per
    pull request instead of every finding.
    """
    lines = hist.evidence(found.get("similar"), found.get("issues"), found.get("closed"))
    none = F.array().cast("array<string>")
    return book.describe(ranked).join(lines, "pr_id", "left").withColumn(
        "evidence", F.coalesce("evidence", none)
    )


def full_review(prs: DataFrame, diffs: DataFrame, as_of: Column | None,
                feedback: DataFrame | None = None, settings: ReviewSettings | None = None,
                **history) -> DataFrame:
    settings = settings or ReviewSettings()
    book = settings.book(diffs.sparkSession)
    ranked = review(diffs, fb.stats(feedback) if feedback is not None else None, settings, book)
    return with_evidence(ranked, book, context(prs, diffs, as_of, **history))
