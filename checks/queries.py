"""Every operator as a named query over whole tables, with SQL where SQL can say it."""

from __future__ import annotations

import warnings

from pyspark.sql import functions as F

from checks import rule_sql as R
from checks.registry import ORACLE, QUERIES, query  # noqa: F401  (re-exported)
from revsieve.functions import languages, scoring, text, vectors
from revsieve.functions.feedback_text import reply_type
from revsieve.operators import cycles, feedback as fb, history as hist, ranking, report
from revsieve.operators import history_as_of as past
from revsieve.operators import similarity as sim
from revsieve.operators import vector_index as vi
from revsieve.operators.catalog import LINE_RULES, Rule, RuleBook, line_rule, merge_rule_tables
from revsieve.operators.relational import missing_tests
from revsieve.operators.scan import scan
from revsieve.plans import review as rv
from revsieve.plans.analyzers import Analyzer, of_columns
from revsieve.plans.lineage import cut, new_dir, stored
from revsieve.sources import feeds, readers, team, writers
from revsieve.sources.stored import StoredTable
from revsieve.streaming import counters, events, expiring, sinks

BOOK = RuleBook.builtin()
VECTOR_THRESHOLD = 0.25  # the given vectors are nearly orthogonal; 0.6 would find none

# -- inputs in library shape -----------------------------------------------------


def feedback_of(t):
    raw = t("feedback").withColumnRenamed("feedback_ts", "ts")
    return fb.from_reactions(raw.withColumn("id", F.col("feedback_id").cast("string")))


def issues_of(t):
    return t("issues").withColumn("labels", F.array("label"))


def edges_of(t):
    """The stored edge table, written once per query."""
    numbers = t("prs").select("pr_id", "pr_number")
    return cut(hist.pr_file_edges(t("file_diffs")).join(numbers, "pr_id"))


def findings_of(t, minimum=0.0):
    return rv.all_findings(t("file_diffs"), BOOK, BOOK.numbers(minimum))


FEEDBACK_SQL = """fb AS (SELECT *, CASE lower(reaction) WHEN '+1' THEN 'positive' WHEN 'thumbs_up' THEN 'positive' WHEN '-1' THEN 'negative'
  WHEN 'thumbs_down' THEN 'negative' WHEN 'heart' THEN 'positive' WHEN 'hooray' THEN 'positive' ELSE 'neutral' END AS feedback_type FROM feedback)"""
STATS_SQL = """stats AS (SELECT analysis_result_id, count(*) AS total_feedback, count(*) FILTER (feedback_type = 'positive') AS positive_count,
  count(*) FILTER (feedback_type = 'negative') AS negative_count, count(*) FILTER (feedback_type = 'neutral') AS neutral_count,
  count(*) FILTER (feedback_type = 'correction') AS correction_count,
  count(*) FILTER (feedback_type = 'positive')::DOUBLE / count(*) AS positive_ratio FROM fb GROUP BY 1)"""
LEARNED_CTES = (
    FEEDBACK_SQL + ",\n" + STATS_SQL + ",\n" + R.findings_ctes() + f""",
adjusted AS (SELECT f.* REPLACE ({R.ADJUSTED} AS confidence) FROM findings f LEFT JOIN stats s USING (analysis_result_id))""")


# -- C: rules --------------------------------------------------------------------

FINDING_COLUMNS = [
    "pr_id", "file_ord", "file_path", "line_start", "match_ord", "rule_id", "category", "priority",
    "confidence", "title", "description", "suggestion", "arg", "code_snippet",
]
FINDING_SQL = ("CAST(file_ord AS BIGINT) AS file_ord, file_path, CAST(line_start AS BIGINT) AS line_start, CAST(match_ord AS BIGINT) AS match_ord, "
               "rule_id, category, priority, round(confidence, 6) AS confidence, title, description, suggestion, arg, code_snippet")


def _register_rule(rule_id: str) -> None:
    needed, rows = R.rule_rows(rule_id)

    @query(f"rule_{rule_id}", f"SELECT pr_id, {FINDING_SQL} FROM ({R.described(rows)}) d",
           ("file_diffs",), R.shared(needed))
    def run(t):
        found = rv.all_findings(t("file_diffs"), BOOK, BOOK.only(rule_id))
        return BOOK.describe(found).select(*FINDING_COLUMNS)


for _rule in BOOK.rules:
    _register_rule(_rule.rule_id)


_SECRET = next(r for r in LINE_RULES if r[0] == "hardcoded_secret")


@query(
    "documents_secret_lines",
    "SELECT doc_id, line_start, match_ord, code_snippet FROM (" + R.snippet_ctes(
        "hardcoded_secret", _SECRET[1], "doc_lines") + ") m",
    ctes="""doc_lines AS (SELECT doc_id, CAST(i AS BIGINT) AS line_start, substring(l, 2) AS content FROM (
  SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM (
   SELECT doc_id, string_split('+' || replace(text, chr(10), chr(10) || '+'), chr(10)) AS ls FROM documents) a) b
  WHERE NOT starts_with(l, '+++'))""")
def documents_secret_lines(t):
    """Line rule over whole documents, each line taken as an added line."""
    docs = t("documents").select(
        F.col("doc_id").cast("string").alias("pr_id"), F.lit(1).alias("file_ord"),
        F.lit("doc").alias("file_path"), F.lit("text").alias("language"),
        F.lit("added").alias("status"), F.lit(0).alias("changes"),
        F.concat(F.lit("+"), F.replace("text", F.lit("\n"), F.lit("\n+"))).alias("diff"),
    )
    return scan(docs, BOOK, BOOK.only("hardcoded_secret")).select(
        F.col("pr_id").cast("bigint").alias("doc_id"), "line_start", "match_ord", "code_snippet"
    )


_CUSTOM = [
    ("print_debug", r"print\(", "code_quality", "medium", 0.75, "Print call left in code", "Remove it"),
    ("await_call", r"await\s+\w+", "performance", "low", 0.6, "Await found", "Check it"),
]


def _custom_book():
    return BOOK.with_line_rules([line_rule(*r) for r in _CUSTOM])


_custom_need, _custom_a = R.rule_rows("print_debug", _custom_book())
_, _custom_b = R.rule_rows("await_call", _custom_book())


@query("custom_rules", f"SELECT pr_id, {FINDING_SQL} FROM ("
       + R.described(f"{_custom_a} UNION ALL {_custom_b}", _custom_book()) + ") d",
       ("file_diffs",), R.shared(_custom_need))
def custom_rules(t):
    checked = rv.check_patterns(
        t.spark, [line_rule(*r) for r in _CUSTOM] + [line_rule("broken", "(", "bug", "low", 0.5, "x", "y")])
    book = BOOK.with_line_rules(checked)
    found = rv.all_findings(t("file_diffs"), book, book.only("print_debug", "await_call"))
    return book.describe(found).select(*FINDING_COLUMNS)


_RULE_VALUES = ", ".join(
    "(" + ", ".join([R.q(r[0]), R.q(r[1]), R.q(r[2]), R.q(r[3]), f"CAST({r[4]} AS DOUBLE)", R.q(r[5]), R.q(r[6]), str(i)]) + ")"
    for i, r in enumerate(LINE_RULES, 1))


@query("custom_rule_override", f"""SELECT coalesce(b.name, u.name) AS name, CASE WHEN u.name IS NOT NULL THEN u.pattern ELSE b.pattern END AS pattern,
  CASE WHEN u.name IS NOT NULL THEN u.confidence ELSE b.confidence END AS confidence, u.name IS NOT NULL AS is_custom, b.name IS NULL AS is_new
 FROM b FULL OUTER JOIN u ON b.name = u.name""",
       ctes=f"""b(name, pattern, category, priority, confidence, message, suggestion, rule_ord) AS (VALUES {_RULE_VALUES}),
u AS (SELECT DISTINCT CASE WHEN p_size % 2 = 0 THEN 'print_debug' ELSE concat('brand_', lower(replace(p_brand, '#', '_'))) END AS name,
  CASE WHEN p_size % 2 = 0 THEN 'print' ELSE p_brand END AS pattern, CAST(0.75 AS DOUBLE) AS confidence FROM part)""")
def custom_rule_override(t):
    cols = "name string, pattern string, category string, priority string, confidence double, message string, suggestion string, rule_ord int"
    builtin = t.spark.createDataFrame([(*r, i) for i, r in enumerate(LINE_RULES, 1)], cols)
    even = F.col("p_size") % 2 == 0
    custom = t("part").select(
        F.when(even, "print_debug").otherwise(
            F.concat(F.lit("brand_"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))))).alias("name"),
        F.when(even, "print").otherwise(F.col("p_brand")).alias("pattern"),
        F.lit("style").alias("category"), F.lit("low").alias("priority"), F.lit(0.75).alias("confidence"),
        F.lit("m").alias("message"), F.lit("s").alias("suggestion"), F.lit(0).alias("rule_ord"),
    ).distinct()
    return merge_rule_tables(builtin, custom).select("name", "pattern", "confidence", "is_custom", "is_new")


# -- B: text ---------------------------------------------------------------------

_EXTS = list(languages.ALL_EXTENSIONS) + [".lock", ".PY", ".tar.gz"]
_EXT_SQL = (
    f"CASE p_partkey % {len(_EXTS) + 1} "
    + " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(_EXTS)) + " ELSE '' END"
)


def _lang_case(table: dict) -> str:
    return "CASE " + " ".join(f"WHEN ends_with(path, '{e}') THEN '{l}'" for e, l in table.items()) + " END"


@query("detect_language",
       f"SELECT p_partkey, path, {_lang_case(languages.CORE_EXTENSIONS)} AS core_language, {_lang_case(languages.ALL_EXTENSIONS)} AS language FROM p",
       ctes=f"p AS (SELECT p_partkey, concat('src/', replace(p_name, ' ', '.'), {_EXT_SQL}) AS path FROM part)")
def detect_language(t):
    p = t("part").selectExpr("p_partkey", f"concat('src/', replace(p_name, ' ', '.'), {_EXT_SQL}) AS path")
    return p.select(
        "p_partkey", "path",
        languages.detect_language(F.col("path"), languages.CORE_EXTENSIONS).alias("core_language"),
        languages.detect_language(F.col("path")).alias("language"),
    )


def _groups_sql(rx: str, n: int) -> str:
    rx = rx.replace("(?d)", "")
    if n == 1:
        merged = f"regexp_extract_all(diff, {R.q(rx)}, 1)"
    else:
        merged = (f"list_transform(list_zip(regexp_extract_all(diff, {R.q(rx)}, 1), regexp_extract_all(diff, {R.q(rx)}, 2)), "
                  "lambda x: CASE WHEN coalesce(x[1], '') <> '' THEN x[1] ELSE x[2] END)")
    return f"list_filter({merged}, lambda x: coalesce(x, '') <> '')"


_IMPORTS_SQL = "CASE language " + " ".join(
    f"WHEN '{l}' THEN {_groups_sql(*languages.IMPORT_PATTERNS[l])}" for l in ("python", "javascript", "java", "go")
) + " ELSE [] END"


@query("extract_imports",
       f"SELECT pr_id, CAST(file_ord AS BIGINT) AS file_ord, language, coalesce(array_to_string({_IMPORTS_SQL}, '|'), '') AS imports FROM file_diffs",
       ("file_diffs",))
def extract_imports(t):
    return t("file_diffs").select(
        "pr_id", "file_ord", "language",
        F.array_join(languages.extract_imports(F.col("diff"), F.col("language")), "|").alias("imports"),
    )


def _functions_sql(lang: str) -> str:
    rx, n = languages.FUNCTION_PATTERNS[lang]
    if lang == "java":  # no look-around in this dialect
        rx = r"(?:public|private|protected)?\s*(?:static)?\s*\w+\s+(\w+)\s*\("
    name = "coalesce(" + ", ".join(f"nullif(regexp_extract(piece, {R.q('^(?:' + rx + ')')}, {g}), '')" for g in range(1, n + 1)) + ")"
    return f"""SELECT pr_id, file_ord, {name} AS name, 1 + coalesce(list_sum(list_transform(pieces[1:i], lambda x: length(x) - length(replace(x, chr(10), '')))), 0) AS line
 FROM (SELECT pr_id, file_ord, pieces, unnest(pieces) AS piece, generate_subscripts(pieces, 1) - 1 AS i FROM (
  SELECT pr_id, file_ord, string_split(regexp_replace(diff, {R.q(rx)}, chr(1) || '\\0', 'g'), chr(1)) AS pieces
  FROM file_diffs WHERE language = '{lang}') a) b WHERE i >= 1"""


@query("extract_functions",
       "SELECT pr_id, CAST(file_ord AS BIGINT) AS file_ord, name, CAST(line AS BIGINT) AS line FROM ("
       + " UNION ALL ".join(_functions_sql(l) for l in ("python", "javascript", "java", "go")) + ") f WHERE name IS NOT NULL",
       ("file_diffs",))
def extract_functions(t):
    found = languages.extract_functions(F.col("diff"), F.col("language"))
    return t("file_diffs").select("pr_id", "file_ord", F.inline(found))


@query("diff_added_lines",
       "SELECT pr_id, CAST(file_ord AS BIGINT) AS file_ord, CAST(line_start AS BIGINT) AS line_no, content FROM added",
       ("file_diffs",), R.shared(["numbered", "added"]))
def diff_added_lines(t):
    readable = (F.col("status") != "removed") & ~F.coalesce("language", F.lit("")).isin("", "binary")
    kept = t("file_diffs").filter(readable).select(
        "pr_id", "file_ord", F.posexplode(text.numbered_lines(F.col("diff"))).alias("pos", "line"))
    return kept.filter(F.col("line").startswith("+")).select(
        "pr_id", "file_ord", (F.col("pos") + 1).alias("line_no"), F.expr("substring(line, 2)").alias("content"))


@query("added_line_imports",
       "SELECT pr_id, CAST(file_ord AS BIGINT) AS file_ord, CAST(pos AS BIGINT) AS pos, imp FROM edges",
       ("file_diffs",), R.shared(["edges"]))
def added_line_imports(t):
    live = t("file_diffs").filter("status <> 'removed'")
    return live.select("pr_id", "file_ord", F.posexplode(text.added_line_imports(F.col("diff"))).alias("pos", "imp"))


_DEPS_SQL = ("list_transform(list_filter(" + _groups_sql(*languages.IMPORT_PATTERNS["python"])
             + ", lambda m: NOT starts_with(m, '.')), lambda m: replace(m, '.', '/') || '.py')[1:10]")


@query("file_dependencies",
       f"SELECT pr_id, CAST(file_ord AS BIGINT) AS file_ord, coalesce(array_to_string({_DEPS_SQL}, '|'), '') AS dependencies FROM file_diffs WHERE language = 'python'",
       ("file_diffs",))
def file_dependencies(t):
    py = t("file_diffs").filter("language = 'python'")
    return py.select("pr_id", "file_ord", F.array_join(
        languages.file_dependencies(F.col("diff"), F.col("language")), "|").alias("dependencies"))


@query("issue_refs", """SELECT pr_id, CAST(i AS BIGINT) AS ref_ord, issue_id FROM (SELECT pr_id, unnest(refs) AS issue_id,
  generate_subscripts(refs, 1) - 1 AS i FROM (SELECT pr_id, regexp_extract_all(description, '#(\\d+)', 1) AS refs FROM prs) a) b""",
       ("prs",))
def issue_refs(t):
    return t("prs").select("pr_id", F.posexplode(text.issue_refs(F.col("description"))).alias("ref_ord", "issue_id"))


@query("pr_key", "SELECT pr_id, concat(repo_owner, '/', repo_name, '#', CAST(pr_number AS VARCHAR)) AS built FROM prs", ("prs",))
def pr_key(t):
    return t("prs").select("pr_id", text.pr_key(F.col("repo_owner"), F.col("repo_name"), F.col("pr_number")).alias("built"))


@query("pr_embedding_text", """SELECT p.pr_id, concat_ws(chr(10), concat('Title: ', title), 'Description: ' || substring(description, 1, 500),
   'Files: ' || files, codes) AS full_text FROM prs p LEFT JOIN (
  SELECT pr_id, string_agg(file_path, ', ' ORDER BY n) AS files, string_agg(CASE WHEN n <= 5 THEN 'Code: ' || substring(diff, 1, 200) END, chr(10) ORDER BY n) AS codes
  FROM (SELECT *, row_number() OVER (PARTITION BY pr_id ORDER BY file_ord) AS n FROM file_diffs) d WHERE n <= 20 GROUP BY 1) f ON f.pr_id = p.pr_id""",
       ("prs", "file_diffs"))
def pr_embedding_text(t):
    return sim.pr_text(t("prs"), t("file_diffs")).select("pr_id", "full_text")


_PLACES_SQL = """texts AS (SELECT p.pr_id, substring(concat_ws(chr(10), concat('Title: ', title), 'Description: ' || substring(description, 1, 500),
   'Files: ' || files, codes), 1, 512) AS text FROM prs p LEFT JOIN (
  SELECT pr_id, string_agg(file_path, ', ' ORDER BY n) AS files, string_agg(CASE WHEN n <= 5 THEN 'Code: ' || substring(diff, 1, 200) END, chr(10) ORDER BY n) AS codes
  FROM (SELECT *, row_number() OVER (PARTITION BY pr_id ORDER BY file_ord) AS n FROM file_diffs) d WHERE n <= 20 GROUP BY 1) f ON f.pr_id = p.pr_id),
word AS (SELECT pr_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+')) AS w FROM texts),
place AS (SELECT pr_id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 384 AS i, count(*) AS c FROM word WHERE w <> '' GROUP BY ALL)"""


@query("hashed_embedding", """SELECT pr_id, 384 AS dimensions, string_agg(concat(i, ':', c), ',' ORDER BY i) AS counts, round(1.0::DOUBLE, 4) AS length FROM place GROUP BY 1""",
       ("prs", "file_diffs"), _PLACES_SQL)
def hashed_embedding(t):
    """Vectors by what they count: multiples of the least entry, which stands for one word."""
    e = sim.embed(sim.pr_text(t("prs"), t("file_diffs")))
    v = F.col("embedding")
    one = F.array_min(F.filter(v, lambda x: x > 0))
    # the least entry is bound first, else it would be looked for anew for each entry
    counted = F.get(F.transform(F.array(one), lambda least: F.transform(
        v, lambda x, i: F.when(x > 0, F.concat_ws(":", i.cast("string"), F.round(x / least).cast("int").cast("string"))))), F.lit(0))
    return e.select("pr_id", F.size(v).alias("dimensions"), F.array_join(F.filter(counted, lambda x: x.isNotNull()), ",").alias("counts"),
                    F.round(vectors.norm(v), 4).alias("length"))


@query("build_history", "SELECT pr_id, 384 AS dimensions, count(*) AS places, any_value(block) AS block FROM place JOIN (SELECT pr_id, concat(repo_owner, '/', repo_name) AS block FROM prs) USING (pr_id) GROUP BY 1",
       ("prs", "file_diffs"), _PLACES_SQL)
def build_history(t):
    """The vectors that a review leaves for later ones."""
    prs = t("prs").withColumn("labels", F.array("label"))
    e = hist.build_history(prs, t("file_diffs"))["pr_embeddings"]
    return e.select("pr_id", F.size("embedding").alias("dimensions"), F.size(F.filter("embedding", lambda x: x > 0)).alias("places"), "block")


@query("vector_cosine", """SELECT a.vec_id, b.vec_id AS other_id, round(list_dot_product(a.e, b.e) / ((sqrt(list_dot_product(a.e, a.e)) + 1e-8)
   * (sqrt(list_dot_product(b.e, b.e)) + 1e-8)), 6) AS similarity FROM v a JOIN v b ON b.vec_id = a.vec_id + 1""",
       ctes="v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)")
def vector_cosine(t):
    e = t("embeddings").select("vec_id", "embedding")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("other_id"), F.col("embedding").alias("other"))
    return e.join(other, "vec_id").select(
        "vec_id", "other_id", vectors.cosine(F.col("embedding"), F.col("other")).alias("similarity"))


# -- A: sources and stored tables --------------------------------------------------


@query("read_file_diffs", f"""SELECT pr_id, CAST(file_ord AS BIGINT) AS file_ord, file_path, md5(CASE WHEN file_ord = 7 THEN '' ELSE diff END) AS diff_md5,
  length(CASE WHEN file_ord = 7 THEN '' ELSE diff END) AS diff_chars, {_lang_case(languages.ALL_EXTENSIONS).replace('path', 'file_path')} AS language FROM file_diffs""",
       ("file_diffs",))
def read_file_diffs(t):
    raw = t("file_diffs").withColumnRenamed("file_path", "filename").withColumn(
        "patch", F.when(F.col("file_ord") != 7, F.col("diff")))
    return readers.file_diffs(raw).select(
        "pr_id", "file_ord", "file_path", F.md5("diff").alias("diff_md5"), F.length("diff").alias("diff_chars"), "language")


@query("read_pr_headers", "SELECT pr_id, pr_number, title, description, state, label AS labels FROM prs", ("prs",))
def read_pr_headers(t):
    raw = t("prs").withColumns({
        "number": F.col("pr_number"), "body": F.col("description"),
        "labels": F.array(F.struct(F.col("label").alias("name")))}).drop("pr_id", "pr_number", "description")
    return readers.pr_headers(raw).select(
        "pr_id", "pr_number", "title", "description", "state", F.array_join("labels", ",").alias("labels"))


@query("read_repositories", """SELECT n_name AS name, r_name || '/' || n_name AS full_name, count(c_custkey) FILTER (WHERE n_nationkey % 2 = 0) AS bytes
  FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2""")
def read_repositories(t):
    sizes = t("customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    raw = (
        t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).join(sizes, "n_nationkey", "left")
        .select(F.col("r_name").alias("owner"), F.col("n_name").alias("name"), F.lit(None).cast("string").alias("full_name"),
                F.when(F.col("n_nationkey") % 2 == 0, F.create_map(F.lit("python"), F.coalesce("n", F.lit(0)))).alias("languages"))
    )
    return readers.repositories(raw).select(
        "name", "full_name", F.coalesce(F.element_at("languages", "python"), F.lit(0)).alias("bytes"))


@query("commit_rollup", """SELECT pr_id, sha, CAST(min(commit_ord) AS BIGINT) AS commit_ord, min(message) AS message, min(author) AS author,
  strftime(min(ts), '%Y-%m-%d') AS ts, CAST(sum(additions) AS BIGINT) AS additions, CAST(sum(deletions) AS BIGINT) AS deletions, count(*) AS n_files FROM commit_files GROUP BY 1, 2""",
       ("commit_files",))
def commit_rollup(t):
    return report.commit_rollup(t("commit_files"))


@query("commit_file_parts", """SELECT pr_id, sha, part, string_agg(filename, '|' ORDER BY filename) AS files_changed FROM (SELECT *,
   CAST(floor((row_number() OVER (PARTITION BY pr_id, sha ORDER BY filename) - 1) / 2) AS BIGINT) AS part FROM all_files) f GROUP BY 1, 2, 3""",
       ("commit_files",), "all_files AS (SELECT pr_id, concat('s', pr_number % 3) AS sha, concat(filename, ' ', commit_ord) AS filename FROM commit_files)")
def commit_file_parts(t):
    """Commits of several files, two to a part."""
    files = t("commit_files").select("pr_id", F.concat(F.lit("s"), F.col("pr_number") % 3).alias("sha"), F.concat_ws(" ", "filename", "commit_ord").alias("filename"))
    return report.commit_file_lists(files, 2).select("pr_id", "sha", "part", F.array_join("files_changed", "|").alias("files_changed"))


@query("commit_file_lists", "SELECT pr_id, sha, CAST(0 AS BIGINT) AS part, string_agg(filename, '|' ORDER BY filename) AS files_changed FROM commit_files GROUP BY 1, 2",
       ("commit_files",))
def commit_file_lists(t):
    return report.commit_file_lists(t("commit_files")).select(
        "pr_id", "sha", "part", F.array_join("files_changed", "|").alias("files_changed"))


@query("pr_document_nested", """SELECT p.pr_id, CAST(0 AS BIGINT) AS part, coalesce(d.n, 0) AS n_diffs, coalesce(d.files, '') AS files,
  coalesce(c.n, 0) AS n_commits, coalesce(i.ids, '') AS issues FROM prs p
 LEFT JOIN (SELECT pr_id, count(*) AS n, string_agg(file_path, '|' ORDER BY file_ord) AS files FROM file_diffs GROUP BY 1) d USING (pr_id)
 LEFT JOIN (SELECT pr_id, count(DISTINCT sha) AS n FROM commit_files GROUP BY 1) c USING (pr_id)
 LEFT JOIN (SELECT pr_id, string_agg(r.issue_id, '|' ORDER BY i) AS ids FROM refs r JOIN issues USING (issue_id) GROUP BY 1) i USING (pr_id)""",
       ("prs", "file_diffs", "commit_files", "issues"),
       """refs AS (SELECT pr_id, unnest(ids) AS issue_id, generate_subscripts(ids, 1) AS i FROM (
  SELECT pr_id, regexp_extract_all(description, '#(\\d+)', 1) AS ids FROM prs) a)""")
def pr_document_nested(t):
    docs = report.pr_documents(
        t("prs"), t("file_diffs"), report.commit_rollup(t("commit_files")),
        hist.related_issues(t("prs"), issues_of(t), by_repo=False))
    return docs.select(
        "pr_id", "part", F.size("diffs").alias("n_diffs"),
        F.array_join(F.col("diffs.file_path"), "|").alias("files"),
        F.size("commit_history").alias("n_commits"),
        F.array_join(F.col("related_issues.issue_id"), "|").alias("issues"))


def _weight_sql(fields: str, n: int) -> str:
    return f"greatest(CAST(ceil((16 * {n} + {fields}) / 2.0::DOUBLE) AS BIGINT), 1)"


_PART_SQL = "CAST(floor((sum(w) OVER (PARTITION BY pr_id ORDER BY {order}) - w) / 1000) AS BIGINT) AS part"
_LEN = "coalesce(strlen(CAST({0} AS VARCHAR)), 0)"
_DIFF_BYTES = _weight_sql(" + ".join(_LEN.format(c) for c in ("file_path", "additions", "deletions", "changes", "status", "language", "diff")), 7)
_COMMIT_BYTES = _weight_sql(" + ".join(_LEN.format(c) for c in ("sha", "message", "author", "ts", "additions", "deletions", "files")), 7)
_ISSUE_BYTES = _weight_sql(" + ".join(_LEN.format(c) for c in ("issue_id", "title", "body", "label", "state")), 5)


@query("pr_documents_whole", """SELECT p.pr_id, coalesce(k.part, 0) AS part, coalesce(diffs, '') AS diffs, coalesce(commits, '') AS commits, coalesce(issues_text, '') AS issues, 'reviewers' AS team
 FROM prs p LEFT JOIN (SELECT pr_id, part FROM dp UNION SELECT pr_id, part FROM cp UNION SELECT pr_id, part FROM ip) k USING (pr_id)
 LEFT JOIN dp USING (pr_id, part) LEFT JOIN cp USING (pr_id, part) LEFT JOIN ip USING (pr_id, part)""",
       ("prs", "file_diffs", "commit_files", "issues"), f"""
dp AS (SELECT pr_id, part, string_agg(concat_ws(':', file_ord, file_path, additions, deletions, changes, status, language, md5(diff)), '|' ORDER BY file_ord) AS diffs
  FROM (SELECT *, {_PART_SQL.format(order='file_ord')} FROM (SELECT *, {_DIFF_BYTES} AS w FROM file_diffs) a) b GROUP BY 1, 2),
cp AS (SELECT pr_id, part, string_agg(concat_ws(':', commit_ord, sha, message, author, CAST(ts AS VARCHAR), additions, deletions, files), '|' ORDER BY commit_ord) AS commits
  FROM (SELECT *, {_PART_SQL.format(order='commit_ord')} FROM (SELECT *, {_COMMIT_BYTES} AS w FROM (
   SELECT pr_id, sha, min(commit_ord) AS commit_ord, min(message) AS message, min(author) AS author, min(ts) AS ts, CAST(sum(additions) AS BIGINT) AS additions,
    CAST(sum(deletions) AS BIGINT) AS deletions, string_agg(filename, '  ' ORDER BY filename) AS files FROM commit_files GROUP BY 1, 2) r) a) b GROUP BY 1, 2),
ip AS (SELECT pr_id, part, string_agg(concat_ws(':', i, issue_id, title, md5(body), label, state), '|' ORDER BY i) AS issues_text
  FROM (SELECT *, {_PART_SQL.format(order='i')} FROM (SELECT *, {_ISSUE_BYTES} AS w FROM (
   SELECT pr_id, unnest(ids) AS issue_id, generate_subscripts(ids, 1) AS i FROM (SELECT pr_id, regexp_extract_all(description, '#(\\d+)', 1) AS ids FROM prs) r) x
   JOIN issues USING (issue_id)) a) b GROUP BY 1, 2)""")
def pr_documents_whole(t):
    """All fields of the nested documents, in parts of about 2,000 bytes."""
    docs = report.pr_documents(
        t("prs"), t("file_diffs"), report.commits_with_files(t("commit_files")), hist.related_issues(t("prs"), issues_of(t), by_repo=False),
        team=team.defaults(t.spark).withColumn("team_name", F.lit("reviewers")), part_bytes=2000)

    def texts(name, *fields):
        return F.array_join(F.transform(name, lambda x: F.concat_ws(":", *(f(x).cast("string") for f in fields))), "|").alias(name)

    get = lambda k: lambda x: x[k]
    return docs.select(
        "pr_id", "part",
        texts("diffs", *map(get, ("file_ord", "file_path", "additions", "deletions", "changes", "status", "language")), lambda x: F.md5(x["diff"])),
        texts("commit_history", *map(get, ("commit_ord", "sha", "message", "author", "ts", "additions", "deletions")),
              lambda x: F.array_join(x["files_changed"], "  ")).alias("commits"),
        texts("related_issues", *map(get, ("issue_ord", "issue_id", "title")), lambda x: F.md5(x["body"]),
              lambda x: F.array_join(x["labels"], ","), get("state")).alias("issues"),
        F.col("team_context.team_name").alias("team"))


@query("related_issues", """SELECT pr_id, CAST(i AS BIGINT) AS ref_ord, issue_id, title, state, label, length(body) AS body_chars FROM (
  SELECT pr_id, unnest(ids) AS issue_id, generate_subscripts(ids, 1) - 1 AS i FROM (
   SELECT pr_id, regexp_extract_all(description, '#(\\d+)', 1) AS ids FROM prs) a) r JOIN issues USING (issue_id)""", ("prs", "issues"))
def related_issues(t):
    return hist.related_issues(t("prs"), issues_of(t), by_repo=False).select(
        "pr_id", "ref_ord", "issue_id", "title", "state", "label", F.length("body").alias("body_chars"))


@query("pr_latest_version", """SELECT pr_id, pr_number, version_id, title, state FROM (
  SELECT *, row_number() OVER (PARTITION BY pr_id ORDER BY updated_at DESC, version_id DESC) AS rn FROM pr_versions) v WHERE rn = 1""",
       ("pr_versions",))
def pr_latest_version(t):
    return hist.latest_versions(t("pr_versions")).select("pr_id", "pr_number", "version_id", "title", "state")


@query("pr_file_edges", "SELECT DISTINCT pr_id, file_path FROM file_diffs WHERE status <> 'removed' AND pr_id IN (SELECT pr_id FROM prs)",
       ("file_diffs", "prs"))
def pr_file_edges(t):
    return hist.pr_file_edges(t("file_diffs"), t("prs"))


@query("file_dep_edges", f"""SELECT DISTINCT src, dst FROM (SELECT file_path AS src, unnest({_DEPS_SQL}) AS dst FROM file_diffs
  WHERE status <> 'removed' AND language = 'python' AND pr_id IN (SELECT pr_id FROM prs)) e""", ("file_diffs", "prs"))
def file_dep_edges(t):
    return hist.file_dep_edges(t("file_diffs"), t("prs"))


@query("team_context_default", """SELECT pr_id, CASE WHEN repo_owner = 'org1' THEN 'camelCase' ELSE 'snake_case' END AS functions,
  CAST(CASE WHEN repo_owner = 'org1' THEN 120 ELSE 100 END AS BIGINT) AS max_line_length, CAST(CASE WHEN repo_owner = 'org1' THEN 1 ELSE 3 END AS BIGINT) AS n_known FROM prs""",
       ("prs",))
def team_context_default(t):
    own = t.spark.sql("""SELECT 'org1' AS team_name, named_struct('naming', named_struct('functions', 'camelCase', 'classes', 'PascalCase', 'constants', 'UPPER'),
      'max_line_length', 120, 'docstring_style', 'numpy') AS coding_conventions, array('Own rule') AS known_patterns,
      array('x') AS anti_patterns, array('y') AS recent_refactors, array('z') AS team_members""")
    return team.attach(t("prs").withColumn("team_name", F.col("repo_owner")), own).select(
        "pr_id", F.col("coding_conventions.naming.functions").alias("functions"),
        F.col("coding_conventions.max_line_length").alias("max_line_length"), F.size("known_patterns").alias("n_known"))


@query("team_file", """SELECT c_mktsegment AS team_name, concat_ws('|', c_mktsegment, 'from ' || n) AS known_patterns, 100 AS max_line_length FROM (
  SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1) c""")
def team_file(t):
    """Team files, each with its own patterns and otherwise the defaults, written and loaded again."""
    counted = t("customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    folder, out = new_dir(t.spark, "teams"), None
    for r in counted.orderBy("c_mktsegment").collect():  # a team is a file; the segments are few
        own = team.defaults(t.spark).withColumn("known_patterns", F.array(F.lit(r["c_mktsegment"]), F.lit(f"from {r['n']}")))
        team.save(own.drop("team_name"), f"{folder}/{r['c_mktsegment'].lower()}")
        loaded = team.load(t.spark, f"{folder}/{r['c_mktsegment'].lower()}", r["c_mktsegment"])
        out = loaded if out is None else out.unionByName(loaded)
    return out.select("team_name", F.array_join("known_patterns", "|").alias("known_patterns"), F.col("coding_conventions.max_line_length").alias("max_line_length"))


@query("vector_of_each", "SELECT pr_id, round(e[1], 6) AS first, len(e) AS dimensions FROM v WHERE pr_number IN (SELECT max(pr_number) FROM v UNION SELECT min(pr_number) FROM v)",
       ("pr_vectors",), "v AS (SELECT pr_id, pr_number, CAST(embedding AS DOUBLE[]) AS e FROM pr_vectors)")
def vector_of_each(t):
    """The point look-up, for the first and the last vector."""
    vectors = t("pr_vectors")
    ends = vectors.agg(F.min_by("pr_id", "pr_number"), F.max_by("pr_id", "pr_number")).first()
    found = sim.vector_of(vectors, ends[0]).unionByName(sim.vector_of(vectors, ends[1]))
    return found.select("pr_id", F.get("embedding", F.lit(0)).cast("double").alias("first"), F.size("embedding").alias("dimensions"))


@query("team_pattern_append", """SELECT DISTINCT c_mktsegment AS team_name, CASE WHEN c_mktsegment = 'BUILDING' THEN 'Always validate user input'
  ELSE concat_ws('|', c_mktsegment, 'Always validate user input') END AS known_patterns FROM customer""")
def team_pattern_append(t):
    teams = t("customer").select(
        F.col("c_mktsegment").alias("team_name"),
        F.array(F.when(F.col("c_mktsegment") == "BUILDING", "Always validate user input").otherwise(F.col("c_mktsegment"))).alias("known_patterns"),
    ).distinct()
    return team.add_pattern(teams, "Always validate user input").select(
        "team_name", F.array_join("known_patterns", "|").alias("known_patterns"))


# -- D, E, F: history ----------------------------------------------------------------

_EDGES_SQL = """e AS MATERIALIZED (SELECT DISTINCT d.pr_id, p.pr_number, d.file_path FROM file_diffs d JOIN prs p ON p.pr_id = d.pr_id WHERE d.status <> 'removed')"""
_COMMON_SQL = """common AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pr_id ORDER BY common_files DESC, other_number DESC, other_id) AS overlap_rank FROM (
   SELECT a.pr_id, b.pr_id AS other_id, b.pr_number AS other_number, count(*) AS common_files FROM e a JOIN e b ON a.file_path = b.file_path
   GROUP BY 1, 2, 3) c) r WHERE overlap_rank <= 10)"""
_OVERLAP_SQL = """overlap AS (SELECT c.pr_id, other_id, other_number, common_files, overlap_rank, common_files::DOUBLE / n AS similarity_score
  FROM common c JOIN (SELECT pr_id, count(*) AS n FROM e GROUP BY 1) s ON s.pr_id = c.pr_id
  WHERE string_split(c.pr_id, '#')[1] = string_split(other_id, '#')[1] AND c.pr_id <> other_id)"""
_VECTOR_SQL = f"""v AS (SELECT pr_id, pr_number, block, CAST(embedding AS DOUBLE[]) AS e FROM pr_vectors),
vec AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pr_id ORDER BY similarity_score DESC, other_number DESC, other_id) AS method_rank FROM (
   SELECT a.pr_id, b.pr_id AS other_id, b.pr_number AS other_number, round(greatest(-1, least(1, list_dot_product(a.e, b.e)
     / ((sqrt(list_dot_product(a.e, a.e)) + 1e-8) * (sqrt(list_dot_product(b.e, b.e)) + 1e-8)))), 6) AS similarity_score
   FROM v a JOIN v b ON a.block = b.block AND a.pr_id <> b.pr_id) s WHERE similarity_score >= {VECTOR_THRESHOLD}) r WHERE method_rank <= 10)"""
_RECENT_SQL = """recent AS MATERIALIZED (SELECT * FROM (SELECT q.pr_id, o.pr_id AS other_id, o.pr_number AS other_number,
   row_number() OVER (PARTITION BY q.pr_id ORDER BY o.created_at DESC, o.pr_number DESC, o.pr_id) AS recent_rank
  FROM prs q JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_owner, repo_name ORDER BY created_at DESC, pr_number DESC, pr_id) AS k
    FROM prs WHERE created_at >= (SELECT max(created_at) FROM prs) - INTERVAL 30 DAY) z WHERE k <= 11) o
   ON o.repo_owner = q.repo_owner AND o.repo_name = q.repo_name AND o.pr_id <> q.pr_id) r WHERE recent_rank <= 10)"""
_SIMILAR_SQL = """found AS (SELECT pr_id, other_id, other_number, similarity_score, method_rank, 1 AS method_ord, 'vector_search' AS method, 'Code similarity' AS reason FROM vec
  UNION ALL SELECT pr_id, other_id, other_number, similarity_score, overlap_rank, 2, 'file_overlap', 'Modified ' || common_files || ' common files' FROM overlap),
every AS (SELECT * FROM found UNION ALL SELECT pr_id, other_id, other_number, 0.5, recent_rank, 3, 'recent', 'Recent PRs in same repo' FROM recent r
  WHERE recent_rank <= 5 AND NOT EXISTS (SELECT 1 FROM found f WHERE f.pr_id = r.pr_id)),
similar_prs AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pr_id ORDER BY similarity_score DESC, method_ord, method_rank) AS similar_rank FROM (
   SELECT *, row_number() OVER (PARTITION BY pr_id, other_number ORDER BY method_ord, method_rank) AS rn FROM every) a WHERE rn = 1) b WHERE similar_rank <= 10)"""
_CLOSED_SQL = """closed AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pr_id ORDER BY other_number DESC, other_id) AS bug_rank FROM (
   SELECT DISTINCT t.pr_id, p.pr_id AS other_id, p.pr_number AS other_number, p.title FROM (SELECT DISTINCT pr_id, file_path FROM file_diffs) t
   JOIN e ON e.file_path = t.file_path JOIN prs p ON p.pr_id = e.pr_id AND p.state = 'closed') d) r WHERE bug_rank <= 5)"""
_ISSUES_SQL = """bug_issues AS MATERIALIZED (SELECT pr_id, i AS ref_ord, issue_id, title FROM (SELECT pr_id, unnest(ids) AS issue_id, generate_subscripts(ids, 1) - 1 AS i FROM (
   SELECT pr_id, regexp_extract_all(description, '#(\\d+)', 1) AS ids FROM prs) a) r JOIN issues USING (issue_id) WHERE label = 'bug' OR contains(lower(title), 'error'))"""
_EVIDENCE_SQL = """bugs AS (SELECT *, row_number() OVER (PARTITION BY pr_id ORDER BY part, ord) AS n FROM (
   SELECT pr_id, 1 AS part, ref_ord AS ord, 'Related to issue #' || issue_id || ': ' || title AS line FROM bug_issues
   UNION ALL SELECT pr_id, 2, bug_rank, 'Similar files modified in PR #' || other_number || ': ' || title FROM closed) b),
ev AS MATERIALIZED (SELECT pr_id, string_agg(line, chr(10) ORDER BY part, ord) AS evidence, list(line ORDER BY part, ord) AS items FROM (
   SELECT pr_id, 0 AS part, similar_rank AS ord, 'Similar pattern in PR #' || other_number || ' (similarity: ' || printf('%.2f', floor(similarity_score * 100 + 0.5) / 100) || ', method: ' || method || ')' AS line
    FROM similar_prs WHERE similar_rank <= 3
   UNION ALL SELECT pr_id, part, n, line FROM bugs WHERE n <= 2) l GROUP BY 1)"""
_HISTORY_NEEDS = ("prs", "file_diffs", "issues", "pr_vectors")
#: The same with the similar pull requests of a table ``vec`` made before.
_TEXT_CTES = [_EDGES_SQL, _COMMON_SQL, _OVERLAP_SQL, _RECENT_SQL, _SIMILAR_SQL, _CLOSED_SQL, _ISSUES_SQL, _EVIDENCE_SQL]
_HISTORY_CTES = ",\n".join(
    [_EDGES_SQL, _COMMON_SQL, _OVERLAP_SQL, _VECTOR_SQL, _RECENT_SQL, _SIMILAR_SQL, _CLOSED_SQL, _ISSUES_SQL, _EVIDENCE_SQL])


@query("related_prs_by_files", "SELECT pr_id, other_id, other_number, common_files, overlap_rank, round(similarity_score, 6) AS similarity_score FROM overlap",
       ("file_diffs", "prs"), ",\n".join([_EDGES_SQL, _COMMON_SQL, _OVERLAP_SQL]))
def related_prs_by_files(t):
    return hist.related_by_files(edges_of(t))


@query("common_file_counts", "SELECT pr_id, other_id, other_number, common_files, overlap_rank FROM common",
       ("file_diffs", "prs"), ",\n".join([_EDGES_SQL, _COMMON_SQL]))
def common_file_counts(t):
    """Degree limit low enough that many files take the path for hot ones."""
    return hist.common_file_counts(edges_of(t), max_degree=8)


@query("similar_prs_vector", "SELECT pr_id, other_id, other_number, similarity_score, method_rank FROM vec", ("pr_vectors",), _VECTOR_SQL)
def similar_prs_vector(t):
    return sim.vector_top_k(t("pr_vectors"), VECTOR_THRESHOLD)


@query("similar_prs_vector_approx")
def similar_prs_vector_approx(t):
    return sim.vector_top_k_approx(t("pr_vectors"), VECTOR_THRESHOLD)


@query("similar_prs_index", "SELECT pr_id, other_id, other_number, similarity_score, method_rank FROM vec WHERE CAST(split_part(pr_id, '#', 2) AS BIGINT) % 100 = 0",
       ("pr_vectors",), _VECTOR_SQL)
def similar_prs_index(t):
    """Every hundredth vector against a stored index of all. Blocks of one cell, as at the small scales, are searched whole."""
    folder = vi.build_index(t("pr_vectors"), threshold=VECTOR_THRESHOLD)
    return vi.search(t.spark, folder, t("pr_vectors").where("pr_number % 100 = 0"), VECTOR_THRESHOLD)


@query("recent_prs", "SELECT pr_id, other_id, other_number, recent_rank FROM recent", ("prs",), _RECENT_SQL)
def recent_prs(t):
    return hist.recent_in_repo(t("prs"), t.newest("orders", "o_orderdate"))


def _context(t):
    return rv.context(
        t("prs"), t("file_diffs"), t.newest("orders", "o_orderdate"), issues_of(t), t("pr_vectors"),
        VECTOR_THRESHOLD, issues_by_repo=False)


@query("similar_prs_merged", "SELECT pr_id, other_id, other_number, round(similarity_score, 6) AS similarity_score, method, reason, similar_rank FROM similar_prs",
       ("prs", "file_diffs", "pr_vectors"), ",\n".join([_EDGES_SQL, _COMMON_SQL, _OVERLAP_SQL, _VECTOR_SQL, _RECENT_SQL, _SIMILAR_SQL]))
def similar_prs_merged(t):
    return _context(t)["similar"].select(
        "pr_id", "other_id", "other_number", "similarity_score", "method", "reason", "similar_rank")


@query("bug_patterns_closed_prs", "SELECT pr_id, other_id, other_number, title, bug_rank, 'historical_bug' AS pattern, 0.6::DOUBLE AS relevance FROM closed",
       ("file_diffs", "prs"), ",\n".join([_EDGES_SQL, _CLOSED_SQL]))
def bug_patterns_closed_prs(t):
    touched = hist.pr_file_edges(t("file_diffs"), keep_removed=True)
    return hist.closed_on_same_files(touched, edges_of(t), t("prs")).drop("source")


@query("bug_patterns_issues", "SELECT pr_id, CAST(ref_ord AS BIGINT) AS ref_ord, issue_id, title, 'bug_report' AS pattern, 0.7::DOUBLE AS relevance FROM bug_issues",
       ("prs", "issues"), _ISSUES_SQL)
def bug_patterns_issues(t):
    return hist.bug_issues(hist.related_issues(t("prs"), issues_of(t), by_repo=False)).drop("source")


# -- history as of each pull request

_PAST_NEEDS = ("file_diffs", "prs")
_PAST_EDGES_SQL = """e AS MATERIALIZED (SELECT DISTINCT d.pr_id, p.pr_number, p.created_at, d.file_path FROM file_diffs d JOIN prs p ON p.pr_id = d.pr_id WHERE d.status <> 'removed')"""
_PAST_COMMON_SQL = _COMMON_SQL.replace("ON a.file_path = b.file_path", "ON a.file_path = b.file_path AND b.created_at < a.created_at")
_PAST_RECENT_SQL = """recent AS MATERIALIZED (SELECT * FROM (SELECT q.pr_id, o.pr_id AS other_id, o.pr_number AS other_number,
   row_number() OVER (PARTITION BY q.pr_id ORDER BY o.created_at DESC, o.pr_number DESC, o.pr_id) AS recent_rank
  FROM prs q JOIN prs o ON o.repo_owner = q.repo_owner AND o.repo_name = q.repo_name AND o.created_at < q.created_at
   AND o.created_at >= q.created_at - INTERVAL 30 DAY) r WHERE recent_rank <= 10)"""
_PAST_CLOSED_SQL = """closed AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pr_id ORDER BY other_number DESC, other_id) AS bug_rank FROM (
   SELECT DISTINCT t.pr_id, p.pr_id AS other_id, p.pr_number AS other_number, p.title FROM (SELECT DISTINCT pr_id, file_path FROM file_diffs) t
   JOIN prs q ON q.pr_id = t.pr_id JOIN e ON e.file_path = t.file_path
   JOIN prs p ON p.pr_id = e.pr_id AND p.state = 'closed' AND p.created_at < q.created_at) d) r WHERE bug_rank <= 5)"""


def _dated_edges(t):
    return cut(hist.pr_file_edges(t("file_diffs")).join(t("prs").select("pr_id", "pr_number", "created_at"), "pr_id"))


@query("recent_prs_as_of", "SELECT pr_id, other_id, other_number, recent_rank FROM recent", ("prs",), _PAST_RECENT_SQL)
def recent_prs_as_of(t):
    return past.recent_as_of(t("prs"))


@query("bug_patterns_as_of", "SELECT pr_id, other_id, other_number, title, bug_rank FROM closed", _PAST_NEEDS, ",\n".join([_PAST_EDGES_SQL, _PAST_CLOSED_SQL]))
def bug_patterns_as_of(t):
    touched = hist.pr_file_edges(t("file_diffs"), keep_removed=True)
    return past.closed_as_of(touched, _dated_edges(t), t("prs")).select("pr_id", "other_id", "other_number", "title", "bug_rank")


@query("related_prs_as_of", "SELECT pr_id, other_id, other_number, common_files, overlap_rank, round(similarity_score, 6) AS similarity_score FROM overlap",
       _PAST_NEEDS, ",\n".join([_PAST_EDGES_SQL, _PAST_COMMON_SQL, _OVERLAP_SQL]))
def related_prs_as_of(t):
    return past.related_as_of(_dated_edges(t))


@query("common_files_as_of", "SELECT pr_id, other_id, other_number, common_files, overlap_rank FROM common",
       _PAST_NEEDS, ",\n".join([_PAST_EDGES_SQL, _PAST_COMMON_SQL]))
def common_files_as_of(t):
    """Degree limit low enough that many files take the path for hot ones."""
    return past.common_as_of(_dated_edges(t), max_degree=8)


_PAST_CTES = ",\n".join([_PAST_EDGES_SQL, _PAST_COMMON_SQL, _OVERLAP_SQL, _VECTOR_SQL, _PAST_RECENT_SQL, _SIMILAR_SQL, _PAST_CLOSED_SQL, _ISSUES_SQL, _EVIDENCE_SQL])


@query("evidence_as_of", "SELECT pr_id, evidence FROM ev", _HISTORY_NEEDS, _PAST_CTES)
def evidence_as_of(t):
    """The lines under a review's findings when every pull request sees only what was there before it."""
    found = rv.context(t("prs"), t("file_diffs"), None, issues_of(t), t("pr_vectors"), VECTOR_THRESHOLD, issues_by_repo=False)
    lines = hist.evidence(found["similar"], found["issues"], found["closed"])
    return lines.select("pr_id", F.array_join("evidence", "\n").alias("evidence"))


@query("hot_files", """SELECT repo_owner, repo_name, file_path, modification_count, hot_rank FROM (SELECT *, row_number() OVER (PARTITION BY repo_owner, repo_name
   ORDER BY modification_count DESC, file_path) AS hot_rank FROM (SELECT repo_owner, repo_name, file_path, count(*) AS modification_count FROM e JOIN prs USING (pr_id)
   GROUP BY 1, 2, 3 HAVING count(*) > 3) c) r WHERE hot_rank <= 10""", ("file_diffs", "prs"), _EDGES_SQL)
def hot_files(t):
    return hist.hot_files(edges_of(t), t("prs"))


@query("import_cycles", """SELECT start, array_to_string(path, ' > ') AS cycle, len(path) - 1 AS length, cycle_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY start ORDER BY len(path), array_to_string(path, ' > ')) AS cycle_rank FROM walk WHERE closed) r WHERE cycle_rank <= 10""",
       ("file_diffs",), R.shared(["edges"]) + """,
g AS (SELECT DISTINCT file_path AS src, imp AS dst FROM edges),
walk AS (SELECT src AS start, dst AS at, [src, dst] AS path, [src || '>' || dst] AS used, src = dst AS closed FROM g
  UNION ALL SELECT w.start, g.dst, list_append(w.path, g.dst), list_append(w.used, g.src || '>' || g.dst), g.dst = w.start
  FROM walk w JOIN g ON g.src = w.at WHERE NOT list_contains(w.used, g.src || '>' || g.dst))""", recursive=True)
def import_cycles(t):
    live = t("file_diffs").filter("status <> 'removed'")
    edges = live.select(F.col("file_path").alias("src"), F.explode(text.added_line_imports(F.col("diff"))).alias("dst"))
    return cycles.import_cycles(edges).select("start", F.concat_ws(" > ", "path").alias("cycle"), "length", "cycle_rank")


@query("evidence_by_pr", "SELECT pr_id, evidence FROM ev", _HISTORY_NEEDS, _HISTORY_CTES)
def evidence_by_pr(t):
    c = _context(t)
    return hist.evidence(c["similar"], c["issues"], c["closed"]).select(
        "pr_id", F.array_join("evidence", "\n").alias("evidence"))


# -- feedback --------------------------------------------------------------------------


@query("reaction_feedback", "SELECT feedback_id, analysis_result_id, reviewer, reaction, feedback_type, 'github_reaction' AS source FROM fb",
       ("feedback",), FEEDBACK_SQL)
def reaction_feedback(t):
    return feedback_of(t).select("feedback_id", "analysis_result_id", "reviewer", "reaction", "feedback_type", "source")


_REPLY_CASE = """CASE WHEN regexp_matches(lower(reply_text), 'thanks|good|helpful|correct|agree') THEN 'positive'
  WHEN regexp_matches(lower(reply_text), 'wrong|incorrect|not|disagree|false') THEN 'negative'
  WHEN regexp_matches(lower(reply_text), 'actually|should be|better|instead') THEN 'correction' ELSE 'neutral' END"""


@query("reply_feedback", f"SELECT conv_id, turn, {_REPLY_CASE} AS feedback_type, CASE WHEN {_REPLY_CASE} = 'correction' THEN reply_text END AS correction FROM replies",
       ("replies",))
def reply_feedback(t):
    return fb.from_replies(t("replies")).select("conv_id", "turn", "feedback_type", "correction")


@query("reply_feedback_whole_words", """SELECT conv_id, turn, CASE WHEN regexp_matches(lower(reply_text), '\\b(?:thanks|good|helpful|correct|agree)\\b') THEN 'positive'
  WHEN regexp_matches(lower(reply_text), '\\b(?:wrong|incorrect|not|disagree|false)\\b') THEN 'negative'
  WHEN regexp_matches(lower(reply_text), '\\b(?:actually|should be|better|instead)\\b') THEN 'correction' ELSE 'neutral' END AS feedback_type FROM replies""",
       ("replies",))
def reply_feedback_whole_words(t):
    return t("replies").select("conv_id", "turn", reply_type(F.col("reply_text"), True).alias("feedback_type"))


@query("auto_detected_feedback", """SELECT a.pr_id, a.analysis_result_id, b.analysis_result_id IS NULL AS was_fixed,
   CASE WHEN b.analysis_result_id IS NULL THEN 'positive' ELSE 'negative' END AS feedback_type, 'system' AS reviewer
 FROM (SELECT * FROM findings WHERE rule_id NOT IN ('circular_dependency', 'missing_tests')) a LEFT JOIN (SELECT DISTINCT pr_id, analysis_result_id FROM findings f
   WHERE rule_id NOT IN ('circular_dependency', 'missing_tests') AND EXISTS (SELECT 1 FROM file_diffs d WHERE d.pr_id = f.pr_id AND d.file_ord = f.file_ord AND d.status <> 'removed')) b
  ON a.pr_id = b.pr_id AND a.analysis_result_id = b.analysis_result_id""", ("file_diffs",), R.findings_ctes())
def auto_detected_feedback(t):
    """The later version of a pull request no longer has its removed files; every rule that looks at one file."""
    only = [n for n in BOOK.numbers() if BOOK.rules[n - 1].rule_id not in ("circular_dependency", "missing_tests")]
    earlier = rv.all_findings(t("file_diffs"), BOOK, only)
    later = rv.all_findings(t("file_diffs").filter("status <> 'removed'"), BOOK, only)
    marked = fb.mark_fixed(*[d.withColumn("analysis_result_id", BOOK.finding_id()) for d in (earlier, later)])
    return fb.from_fixes(marked).select("pr_id", "analysis_result_id", "was_fixed", "feedback_type", "reviewer")


@query("feedback_store", "SELECT CAST(feedback_id AS VARCHAR) AS id, pr_id, analysis_result_id FROM feedback WHERE pr_id IN (SELECT pr_id FROM prs)",
       ("feedback", "prs"))
def feedback_store(t):
    twice = feedback_of(t).unionByName(feedback_of(t))
    return fb.store(twice, t("prs"))[1]


@query("feedback_stats", """SELECT analysis_result_id, total_feedback, positive_count, negative_count, neutral_count, correction_count,
  round(positive_ratio, 6) AS positive_ratio FROM stats""", ("feedback",), FEEDBACK_SQL + ",\n" + STATS_SQL)
def feedback_stats(t):
    return fb.stats(feedback_of(t))


@query("feedback_recent", """SELECT analysis_result_id, CAST(feedback_id AS VARCHAR) AS id, row_number() OVER (PARTITION BY analysis_result_id
   ORDER BY feedback_ts DESC, CAST(feedback_id AS VARCHAR) DESC) AS position FROM feedback""", ("feedback",))
def feedback_recent(t):
    return fb.newest_first(feedback_of(t)).select("analysis_result_id", "id", "position")


_MULT = """CASE feedback_type WHEN 'positive' THEN 1.1::DOUBLE + least(n / 10.0::DOUBLE, 0.2::DOUBLE) WHEN 'negative' THEN 0.9::DOUBLE - least(n / 10.0::DOUBLE, 0.2::DOUBLE)
  WHEN 'correction' THEN 0.95 WHEN 'ignored' THEN 0.85 ELSE 1.0 END"""


@query("feedback_patterns", f"""SELECT category || '_' || feedback_type AS pattern_id, category, feedback_type,
   feedback_type || ' feedback for ' || category || ' category' AS pattern_description, n AS feedback_count, round({_MULT}, 6) AS confidence_multiplier
 FROM (SELECT category, feedback_type, count(*) AS n FROM fb WHERE feedback_ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY 1, 2 HAVING count(*) >= 3) g""",
       ("feedback",), FEEDBACK_SQL)
def feedback_patterns(t):
    return fb.patterns(feedback_of(t), t.newest("events", "ts"), days=7).drop("pattern_type")


_CATEGORY_SQL = """adj AS (SELECT category, p / n AS positive_ratio, g / n AS negative_ratio,
   greatest(0.7::DOUBLE, least(1.3::DOUBLE, 1.0::DOUBLE + (p / n - g / n) * 0.3::DOUBLE)) AS multiplier FROM (
  SELECT category, count(*)::DOUBLE AS n, (count(*) FILTER (feedback_type = 'positive'))::DOUBLE AS p, (count(*) FILTER (feedback_type = 'negative'))::DOUBLE AS g
  FROM fb GROUP BY 1 HAVING count(*) >= 5) s)"""


@query("category_adjustments", "SELECT category, round(positive_ratio, 6) AS positive_ratio, round(negative_ratio, 6) AS negative_ratio, round(multiplier, 6) AS multiplier FROM adj",
       ("feedback",), FEEDBACK_SQL + ",\n" + _CATEGORY_SQL)
def category_adjustments(t):
    return fb.category_adjustments(feedback_of(t))


_LEARNED_SQL = """learned AS MATERIALIZED (SELECT prefix || '_' || category || '_' || md5(directory) AS pattern_id, category, '^' || regexp_replace(directory, '([.^$|?*+()\\[\\]{}])', '\\\\\\1', 'g') AS file_pattern,
   n AS feedback_count, m AS multiplier FROM (
  SELECT category, CASE WHEN contains(file_path, '/') THEN regexp_extract(file_path, '^(.*/)', 1) ELSE '' END AS directory, count(*) AS n,
   (count(*) FILTER (feedback_type = 'negative'))::DOUBLE / count(*) AS neg, (count(*) FILTER (feedback_type = 'positive'))::DOUBLE / count(*) AS pos FROM fb GROUP BY 1, 2) g,
  (VALUES ('fp', 0.7::DOUBLE), ('fn', 1.2::DOUBLE)) k(prefix, m)
  WHERE n >= 5 AND ((prefix = 'fp' AND neg >= 0.2) OR (prefix = 'fn' AND pos >= 0.6)))"""


def learned_of(t):
    f = feedback_of(t)
    return fb.learned_rows(f, "false_positive", min_share=0.2).unionByName(
        fb.learned_rows(f, "false_negative", min_share=0.6, counted="positive"))


@query("learned_pattern_rows", "SELECT pattern_id, category, file_pattern, feedback_count, multiplier AS confidence_multiplier FROM learned",
       ("feedback",), FEEDBACK_SQL + ",\n" + _LEARNED_SQL)
def learned_pattern_rows(t):
    return learned_of(t).select("pattern_id", "category", "file_pattern", "feedback_count", "confidence_multiplier")


_KEYS = ["pr_id", "file_ord", "rule_no", "line_start", "match_ord"]


@query("learned_patterns_match", """SELECT pr_id, CAST(file_ord AS BIGINT) AS file_ord, rule_id, CAST(line_start AS BIGINT) AS line_start, CAST(match_ord AS BIGINT) AS match_ord, pattern_id
 FROM findings f JOIN learned p ON f.category = p.category AND regexp_matches(f.file_path, p.file_pattern)""",
       ("feedback",), FEEDBACK_SQL + ",\n" + _LEARNED_SQL + ",\n" + R.findings_ctes())
def learned_patterns_match(t):
    found = findings_of(t).withColumn("category", BOOK.lookup("category"))
    return fb.match_patterns(found, learned_of(t)).select(
        "pr_id", "file_ord", BOOK.lookup("rule_id").alias("rule_id"), "line_start", "match_ord",
        F.col("p_pattern_id").alias("pattern_id"))


@query("learned_patterns_apply", """SELECT f.pr_id, CAST(f.file_ord AS BIGINT) AS file_ord, f.rule_id, CAST(f.line_start AS BIGINT) AS line_start, CAST(f.match_ord AS BIGINT) AS match_ord,
   round(CASE WHEN m.k IS NULL THEN confidence ELSE greatest(0, least(1, confidence * m.k)) END, 6) AS confidence
 FROM findings f LEFT JOIN (SELECT pr_id, file_ord, rule_no, line_start, match_ord, product(multiplier) AS k
   FROM findings f JOIN learned p ON f.category = p.category AND regexp_matches(f.file_path, p.file_pattern) GROUP BY ALL) m USING (pr_id, file_ord, rule_no, line_start, match_ord)""",
       ("feedback",), FEEDBACK_SQL + ",\n" + _LEARNED_SQL + ",\n" + R.findings_ctes())
def learned_patterns_apply(t):
    found = findings_of(t).withColumn("category", BOOK.lookup("category"))
    return fb.apply_patterns(found, learned_of(t), _KEYS).select(
        "pr_id", "file_ord", BOOK.lookup("rule_id").alias("rule_id"), "line_start", "match_ord", "confidence")


@query("category_adjusted_findings", """SELECT pr_id, CAST(file_ord AS BIGINT) AS file_ord, rule_id, CAST(line_start AS BIGINT) AS line_start, CAST(match_ord AS BIGINT) AS match_ord,
  round(CASE WHEN multiplier IS NULL THEN confidence ELSE least(1.0::DOUBLE, confidence * multiplier) END, 6) AS confidence
 FROM findings f LEFT JOIN adj USING (category)""", ("feedback",), FEEDBACK_SQL + ",\n" + _CATEGORY_SQL + ",\n" + R.findings_ctes())
def category_adjusted_findings(t):
    found = findings_of(t).withColumn("category", BOOK.lookup("category"))
    return fb.apply_category_multipliers(found, fb.category_adjustments(feedback_of(t))).select(
        "pr_id", "file_ord", BOOK.lookup("rule_id").alias("rule_id"), "line_start", "match_ord", "confidence")


@query("adjusted_confidence", """SELECT pr_id, analysis_result_id, rule_id, CAST(line_start AS BIGINT) AS line_start, CAST(match_ord AS BIGINT) AS match_ord, round(confidence, 6) AS confidence,
  CASE WHEN confidence >= 0.9 THEN 'very_high' WHEN confidence >= 0.7 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' WHEN confidence >= 0.3 THEN 'low' ELSE 'very_low' END AS confidence_level FROM adjusted""",
       ("feedback",), LEARNED_CTES)
def adjusted_confidence(t):
    found = rv.learn(findings_of(t), BOOK, fb.stats(feedback_of(t)))
    return BOOK.describe(found).select(
        "pr_id", "analysis_result_id", "rule_id", "line_start", "match_ord", "confidence", "confidence_level")


# -- ranking and review ----------------------------------------------------------------

_RANK_SQL = "CAST(line_start AS BIGINT) AS line_start, rule_id, round(confidence, 6) AS confidence, round(score, 6) AS score"


@query("priority_score", f"SELECT pr_id, file_path, {_RANK_SQL}, CAST(match_ord AS BIGINT) AS match_ord FROM scored",
       ("file_diffs",), R.findings_ctes(0.6) + ",\n" + R.ranked_ctes())
def priority_score(t):
    return ranking.score_findings(findings_of(t, 0.6), BOOK).select(
        "pr_id", "file_path", "line_start", BOOK.lookup("rule_id").alias("rule_id"), "confidence", "score", "match_ord")


@query("findings_deduped", f"SELECT pr_id, file_path, {_RANK_SQL}, CAST(match_ord AS BIGINT) AS match_ord FROM deduped",
       ("file_diffs",), R.findings_ctes(0.6) + ",\n" + R.ranked_ctes())
def findings_deduped(t):
    return ranking.dedupe_findings(ranking.score_findings(findings_of(t, 0.6), BOOK), BOOK).select(
        "pr_id", "file_path", "line_start", BOOK.lookup("rule_id").alias("rule_id"), "confidence", "score", "match_ord")


@query("review_top_findings", f"SELECT pr_id, rank, file_path, {_RANK_SQL}, title, code_snippet FROM ranked",
       ("file_diffs",), R.findings_ctes(0.6) + ",\n" + R.ranked_ctes())
def review_top_findings(t):
    return BOOK.describe(rv.review(t("file_diffs"))).select(
        "pr_id", "rank", "file_path", "line_start", "rule_id", "confidence", "score", "title", "code_snippet")


@query("review_top3", f"SELECT pr_id, rank, file_path, {_RANK_SQL} FROM ranked",
       ("file_diffs",), R.findings_ctes(0.6) + ",\n" + R.ranked_ctes(limit=3))
def review_top3(t):
    top = rv.review(t("file_diffs"), settings=rv.ReviewSettings(max_results=3))
    return top.select("pr_id", "rank", "file_path", "line_start", BOOK.lookup("rule_id").alias("rule_id"), "confidence", "score")


@query("review_with_feedback", f"SELECT pr_id, rank, file_path, {_RANK_SQL} FROM ranked",
       ("feedback",), LEARNED_CTES + ",\n" + R.ranked_ctes("adjusted"))
def review_with_feedback(t):
    top = rv.review(t("file_diffs"), fb.stats(feedback_of(t)))
    return top.select("pr_id", "rank", "file_path", "line_start", BOOK.lookup("rule_id").alias("rule_id"), "confidence", "score")


_LEARNED_ADJUSTED = """patterned AS (SELECT a.* REPLACE (CASE WHEN m.k IS NULL THEN confidence ELSE greatest(0, least(1, confidence * m.k)) END AS confidence)
  FROM adjusted a LEFT JOIN (SELECT pr_id, file_ord, file_path, rule_no, line_start, match_ord, product(multiplier) AS k
   FROM findings f JOIN learned p ON f.category = p.category AND regexp_matches(f.file_path, p.file_pattern) GROUP BY ALL) m USING (pr_id, file_ord, file_path, rule_no, line_start, match_ord)),
recorded AS (SELECT p.* REPLACE (CASE WHEN multiplier IS NULL THEN confidence ELSE greatest(0, least(1.0::DOUBLE, confidence * multiplier)) END AS confidence)
  FROM patterned p LEFT JOIN adj USING (category))"""


@query("review_learned", f"SELECT pr_id, rank, file_path, {_RANK_SQL} FROM ranked",
       ("feedback",), ",\n".join([LEARNED_CTES, _LEARNED_SQL, _CATEGORY_SQL, _LEARNED_ADJUSTED, R.ranked_ctes("recorded")]))
def review_learned(t):
    """A review with all three kinds of learning: the finding's own feedback, learned patterns, the category's record."""
    f = feedback_of(t)
    settings = rv.ReviewSettings(learned_patterns=cut(learned_of(t)), category_adjustments=cut(fb.category_adjustments(f)))
    return rv.review(t("file_diffs"), fb.stats(f), settings).select(
        "pr_id", "rank", "file_path", "line_start", BOOK.lookup("rule_id").alias("rule_id"), "confidence", "score")


def _own_analyzers():
    """A relational one, one of conditions, one that can't be planned and one that fails when it runs."""
    def rule(rule_id, category, priority, confidence, title, **more):
        return Rule(rule_id, "", category, priority, confidence, title, title + " in {path}", "Look at it", **more)

    wide = rule("wide_pull_request", "architecture", "high", 0.8, "Many files in one pull request", arg_key="files", check_ord=1)
    migration = rule("sql_file", "business_logic", "medium", 0.9, "Migration changed", check_ord=1)
    big = rule("big_sql_file", "business_logic", "low", 0.7, "Large migration", check_ord=2)
    low = rule("never_reported", "style", "low", 0.1, "Below any threshold")

    def find_wide(diffs):
        return diffs.groupBy("pr_id").agg(F.count("*").alias("n"), F.min("file_path").alias("file_path")).where("n >= 6").select(
            "pr_id", "file_path", F.lit("wide_pull_request").alias("rule_id"), F.col("n").cast("string").alias("arg"))

    def find_bad(diffs):
        return diffs.select("pr_id", "file_path", F.when(F.length("diff") > 0, F.raise_error(F.lit("no such service"))).alias("rule_id"))

    return [
        Analyzer("breadth", (wide,), find_wide),
        of_columns("migrations", [(migration, lambda: F.col("file_path").startswith("db/sql/")),
                                  (big, lambda: F.col("file_path").startswith("db/sql/") & (F.col("changes") > 100)), (low, lambda: F.lit(True))]),
        Analyzer("unplanned", (rule("x", "bug", "low", 0.9, "X"),), lambda diffs: diffs.select("no_such_column")),
        Analyzer("failing", (rule("y", "bug", "low", 0.9, "Y"),), find_bad),
    ]


_OWN_BOOK = rv.ReviewSettings(analyzers=_own_analyzers()).book()


def _own_row(rule_id, file_ord, arg="NULL"):
    no = _OWN_BOOK.by_id[rule_id]
    return (f"SELECT pr_id, {file_ord} AS file_ord, file_path, 1 AS line_start, 0 AS match_ord, {arg} AS arg, NULL AS code_snippet, {no} AS rule_no, "
            f"CAST({_OWN_BOOK.rules[no - 1].confidence} AS DOUBLE) AS confidence")


_OWN_ROWS = f"""{_own_row('wide_pull_request', 0, 'CAST(n AS VARCHAR)')} FROM (SELECT pr_id, count(*) AS n, min(file_path) AS file_path FROM file_diffs GROUP BY 1) w WHERE n >= 6
 UNION ALL {_own_row('sql_file', 'file_ord')} FROM file_diffs WHERE starts_with(file_path, 'db/sql/')
 UNION ALL {_own_row('big_sql_file', 'file_ord')} FROM file_diffs WHERE starts_with(file_path, 'db/sql/') AND changes > 100"""


@query("review_own_analyzers", f"SELECT pr_id, rank, file_path, {_RANK_SQL}, title, 'unplanned, failing' AS left_out FROM ranked",
       ("file_diffs",), R.findings_ctes(0.6, _OWN_BOOK, _OWN_ROWS) + ",\n" + R.ranked_ctes())
def review_own_analyzers(t):
    settings = rv.ReviewSettings(analyzers=_own_analyzers())
    book = settings.book()
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")  # two of them are meant to fail
        top = rv.review(t("file_diffs"), settings=settings, book=book)
    return top.select("pr_id", "rank", "file_path", "line_start", book.lookup("rule_id").alias("rule_id"), "confidence", "score",
                      book.lookup("title").alias("title"), F.lit(", ".join(n for n, _ in settings.failed)).alias("left_out"))


@query("review_full", f"SELECT r.pr_id, rank, file_path, {_RANK_SQL}, coalesce(evidence, '') AS evidence FROM ranked r LEFT JOIN ev ON ev.pr_id = r.pr_id",
       (*_HISTORY_NEEDS, "feedback"), _HISTORY_CTES + ",\n" + LEARNED_CTES + ",\n" + R.ranked_ctes("adjusted"))
def review_full(t):
    full = rv.full_review(
        t("prs"), t("file_diffs"), t.newest("orders", "o_orderdate"), feedback_of(t),
        issues=issues_of(t), vectors=t("pr_vectors"), vector_threshold=VECTOR_THRESHOLD, issues_by_repo=False)
    return full.select("pr_id", "rank", "file_path", "line_start", "rule_id", "confidence", "score",
                       F.array_join("evidence", "\n").alias("evidence"))


_TEXT_VECTOR_SQL = """unit AS (SELECT pr_id, i, CAST(c / sqrt(sum(c * c) OVER (PARTITION BY pr_id)) AS FLOAT)::DOUBLE AS x FROM place),
scaled AS (SELECT u.pr_id, pr_number, concat(repo_owner, '/', repo_name) AS block, i, x / (sqrt(sum(x * x) OVER (PARTITION BY u.pr_id)) + 1e-8) AS x FROM unit u JOIN prs USING (pr_id)),
vec AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pr_id ORDER BY similarity_score DESC, other_number DESC, other_id) AS method_rank FROM (
   SELECT a.pr_id, b.pr_id AS other_id, b.pr_number AS other_number, round(greatest(-1, least(1, sum(a.x * b.x))), 6) AS similarity_score
   FROM scaled a JOIN scaled b ON a.block = b.block AND a.i = b.i AND a.pr_id <> b.pr_id GROUP BY 1, 2, 3) s WHERE similarity_score >= 0.6) r WHERE method_rank <= 10)"""


@query("similar_prs_text", "SELECT pr_id, other_id, other_number, similarity_score, method_rank FROM vec", ("prs", "file_diffs"),
       ",\n".join([_PLACES_SQL, _TEXT_VECTOR_SQL]))
def similar_prs_text(t):
    """Text, embedding and search."""
    return sim.vector_top_k(stored(sim.pr_vectors(t("prs"), t("file_diffs"))))


@query("review_full_text", f"SELECT r.pr_id, rank, file_path, {_RANK_SQL}, coalesce(evidence, '') AS evidence FROM ranked r LEFT JOIN ev ON ev.pr_id = r.pr_id",
       ("prs", "file_diffs", "issues", "feedback"), ",\n".join([_PLACES_SQL, _TEXT_VECTOR_SQL, *_TEXT_CTES, LEARNED_CTES, R.ranked_ctes("adjusted")]))
def review_full_text(t):
    """A full review whose similar pull requests come from their own texts."""
    full = rv.full_review(t("prs"), t("file_diffs"), t.newest("orders", "o_orderdate"), feedback_of(t), issues=issues_of(t),
                          text_vectors=True, issues_by_repo=False)
    return full.select("pr_id", "rank", "file_path", "line_start", "rule_id", "confidence", "score",
                       F.array_join("evidence", "\n").alias("evidence"))


@query("missing_tests_strict", """SELECT pr_id, CAST(file_ord AS BIGINT) AS file_ord, file_path FROM candidates c WHERE NOT EXISTS (SELECT 1 FROM file_diffs t
  WHERE t.pr_id = c.pr_id AND t.status <> 'removed' AND (contains(t.file_path, c.base) OR replace(replace(t.file_path, 'test_', ''), '_test', '') = c.base))""",
       ("file_diffs",), R.shared(["candidates"]))
def missing_tests_strict(t):
    return missing_tests(t("file_diffs"), BOOK, strict=True, small_set=2).select("pr_id", "file_ord", "file_path")


@query("evidence_findings", """SELECT r.pr_id, rank, analysis_result_id, coalesce(len(items), 0) AS n_evidence FROM ranked r LEFT JOIN ev ON ev.pr_id = r.pr_id""",
       _HISTORY_NEEDS, _HISTORY_CTES + ",\n" + R.findings_ctes(0.6) + ",\n" + R.ranked_ctes())
def evidence_findings(t):
    full = rv.with_evidence(rv.review(t("file_diffs")), BOOK, _context(t))
    return full.select("pr_id", "rank", "analysis_result_id", F.size("evidence").alias("n_evidence"))


# -- reports -------------------------------------------------------------------------

_FIRST_COMMIT = "fc AS (SELECT pr_id, min_by(sha, commit_ord) AS commit_id FROM commit_files GROUP BY 1)"
_EMOJI = "CASE category " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in report.CATEGORY_EMOJI.items()) + f" ELSE '{report.OTHER_EMOJI}' END"
_BODY_SQL = f"""concat({_EMOJI}, ' **', title, '** **[', upper(priority), ']**', chr(10), chr(10), description, chr(10), chr(10), '**Suggestion:** ', suggestion,
  chr(10), chr(10), '**Confidence:** ', CAST(CAST(round(confidence * 100, 6) AS INTEGER) AS VARCHAR), '%',
  CASE WHEN items IS NOT NULL THEN concat(chr(10), chr(10), '**Related:**', chr(10), array_to_string(list_transform(items[1:3], lambda e: '- ' || e || chr(10)), '')) ELSE '' END,
  CASE WHEN coalesce(code_snippet, '') <> '' THEN concat(chr(10), '```', chr(10), substring(code_snippet, 1, 200), chr(10), '```') ELSE '' END,
  chr(10), chr(10), '---', chr(10), '💬 **Was this helpful?** React with 👍 or 👎 to help improve future reviews.', chr(10), '<!-- analysis_result_id: ', analysis_result_id, ' -->')"""


@query("comment_body", f"SELECT r.pr_id, commit_id, rank, {_BODY_SQL} AS body FROM ranked r JOIN fc ON fc.pr_id = r.pr_id LEFT JOIN ev ON ev.pr_id = r.pr_id",
       (*_HISTORY_NEEDS, "commit_files"), _HISTORY_CTES + ",\n" + _FIRST_COMMIT + ",\n" + R.findings_ctes(0.6) + ",\n" + R.ranked_ctes())
def comment_body(t):
    full = rv.with_evidence(rv.review(t("file_diffs")), BOOK, _context(t))
    return report.comments(full, report.commit_rollup(t("commit_files"))).select("pr_id", "commit_id", "rank", "body")


@query("comments_read_back", """SELECT r.pr_id, count(*) AS comments_posted, string_agg(CAST(rank AS VARCHAR), ',' ORDER BY rank) AS ranks
 FROM ranked r JOIN fc ON fc.pr_id = r.pr_id GROUP BY 1""", ("commit_files", "file_diffs"), _FIRST_COMMIT + ",\n" + R.findings_ctes(0.6) + ",\n" + R.ranked_ctes())
def comments_read_back(t):
    """Comments as they are written by repository, counted as they are read back."""
    ranked = BOOK.describe(rv.review(t("file_diffs"))).withColumn("evidence", F.array().cast("array<string>"))
    made, folder = report.comments(ranked, report.commit_rollup(t("commit_files"))), new_dir(t.spark, "comments")
    writers.write_comments(made, folder)
    back = t.spark.read.schema(made.schema).parquet(folder)
    ranks = back.groupBy("pr_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("rank")), lambda r: r.cast("string")), ",").alias("ranks"))
    return report.comments_posted(back).join(ranks, "pr_id")


@query("review_summary", """SELECT 'success' AS status, p.pr_id, p.pr_number, coalesce(n, 0) AS results_count,
   CASE WHEN c.pr_id IS NULL THEN 0 ELSE coalesce(n, 0) END AS comments_posted, coalesce(top, '') AS top
 FROM prs p LEFT JOIN (SELECT pr_id, count(*) AS n, string_agg(CASE WHEN rank <= 10 THEN title END, '|' ORDER BY rank) AS top FROM ranked GROUP BY 1) r ON r.pr_id = p.pr_id
 LEFT JOIN fc c ON c.pr_id = p.pr_id""", ("prs", "commit_files", "file_diffs"),
       _FIRST_COMMIT + ",\n" + R.findings_ctes(0.6) + ",\n" + R.ranked_ctes())
def review_summary(t):
    ranked = BOOK.describe(rv.review(t("file_diffs"))).withColumn("evidence", F.array().cast("array<string>"))
    written = report.comments(ranked, report.commit_rollup(t("commit_files")))
    return report.review_response(t("prs"), ranked, written).select(
        "status", "pr_id", "pr_number", "results_count", "comments_posted",
        F.array_join(F.transform("results", lambda r: r["title"]), "|").alias("top"))


_REPORT_NEEDS = ("prs", "file_diffs", "feedback")
_RANKED = R.findings_ctes(0.6) + ",\n" + R.ranked_ctes()


def _ranked(t):
    return BOOK.describe(rv.review(t("file_diffs")))


#: Mean to six places by whole numbers, halves upwards.
_MEAN_SQL = "((2 * sum(CAST(round(confidence * 1e6) AS BIGINT))::BIGINT + count(*)) // (2 * count(*))) / 1e6::DOUBLE"


@query("overview_stats", f"""SELECT (SELECT count(*) FROM prs) AS total_reviews,
  (SELECT count(*) FROM prs WHERE created_at::DATE = (SELECT max(created_at)::DATE FROM prs)) AS reviews_today,
  (SELECT count(*) FROM prs WHERE created_at::DATE > (SELECT max(created_at)::DATE FROM prs) - 7) AS reviews_this_week,
  (SELECT {_MEAN_SQL} FROM ranked) AS average_confidence, (SELECT count(*) FROM fb) AS total_feedback,
  (SELECT round((count(*) FILTER (feedback_type = 'positive'))::DOUBLE / count(*), 6) FROM fb) AS positive_ratio""",
       _REPORT_NEEDS, FEEDBACK_SQL + ",\n" + _RANKED)
def overview_stats(t):
    return report.overview(t("prs"), rv.review(t("file_diffs")), feedback_of(t), t.newest("orders", "o_orderdate"))


@query("category_distribution", "SELECT category, count(*) AS n FROM ranked GROUP BY 1", ("file_diffs",), _RANKED)
def category_distribution(t):
    return report.distribution(_ranked(t), "category")


@query("priority_distribution", "SELECT priority, count(*) AS n FROM ranked GROUP BY 1", ("file_diffs",), _RANKED)
def priority_distribution(t):
    return report.distribution(_ranked(t), "priority")


@query("category_distribution_map", """SELECT string_agg(category || '=' || n, ',' ORDER BY category) AS category_distribution
  FROM (SELECT category, count(*) AS n FROM ranked GROUP BY 1) c""", ("file_diffs",), _RANKED)
def category_distribution_map(t):
    m = report.distribution_map(_ranked(t), "category")
    entries = F.sort_array(F.map_entries("category_distribution"))
    return m.select(F.array_join(F.transform(
        entries, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("category_distribution"))


@query("top_categories", "SELECT category, count(*) AS n FROM ranked GROUP BY 1 ORDER BY n DESC, category LIMIT 3", ("file_diffs",), _RANKED)
def top_categories(t):
    return report.top_categories(_ranked(t), 3)


@query("results_per_pr", "SELECT pr_id, count(*) AS results_count FROM ranked GROUP BY 1", ("file_diffs",), _RANKED)
def results_per_pr(t):
    return report.results_per_pr(rv.review(t("file_diffs")))


@query("reviews_over_time", """SELECT strftime(d.day, '%Y-%m-%d') AS day, count(p.pr_id) AS reviews FROM (
  SELECT (SELECT max(created_at)::DATE FROM prs) - CAST(i AS INTEGER) AS day FROM range(30) r(i)) d LEFT JOIN prs p ON p.created_at::DATE = d.day GROUP BY 1""", ("prs",))
def reviews_over_time(t):
    return report.reviews_over_time(t("prs"), t.newest("orders", "o_orderdate"))


@query("confidence_trend", f"""SELECT strftime(created_at, '%Y-%m-%d') AS day, {_MEAN_SQL} AS average_confidence, count(*) AS findings
 FROM ranked JOIN prs USING (pr_id) WHERE created_at::DATE > (SELECT max(created_at)::DATE FROM prs) - 90 GROUP BY 1""", ("prs", "file_diffs"), _RANKED)
def confidence_trend(t):
    return report.confidence_trend(rv.review(t("file_diffs")), t("prs"), t.newest("orders", "o_orderdate"), 90)


@query("findings_page", """SELECT pr_id, rank, title, round(score, 6) AS score FROM ranked WHERE category = 'security' AND priority = 'medium'
  ORDER BY score DESC, pr_id, rank LIMIT 50 OFFSET 100""", ("file_diffs",), _RANKED)
def findings_page(t):
    order = [F.col("score").desc(), F.col("pr_id"), F.col("rank")]
    return report.findings_page(_ranked(t), order, "security", "medium", 50, 100).select("pr_id", "rank", "title", "score")


@query("findings_total", "SELECT count(*) AS total FROM ranked WHERE category = 'security' AND priority = 'medium'", ("file_diffs",), _RANKED)
def findings_total(t):
    return report.findings_total(_ranked(t), "security", "medium")


# -- I: events and streams ---------------------------------------------------------------

_ROUTE_CTES = """parsed AS (SELECT event_id, ts, event_type, json_extract_string(payload, '$.action') AS action,
   coalesce(nullif(json_extract_string(payload, '$.repository.owner.login'), ''), nullif(json_extract_string(payload, '$.repository.owner.name'), '')) AS repo_owner,
   nullif(json_extract_string(payload, '$.repository.name'), '') AS repo_name, CAST(json_extract_string(payload, '$.pull_request.number') AS BIGINT) AS pr_number,
   CAST(json_extract_string(payload, '$.issue.number') AS BIGINT) AS issue_number, json_extract_string(payload, '$.issue.html_url') AS html_url,
   json_extract_string(payload, '$.comment.body') AS body, json_extract_string(payload, '$.comment.user.login') AS login FROM webhook_events),
routed AS (SELECT *, repo_owner IS NOT NULL AND repo_name IS NOT NULL AND coalesce(pr_number, 0) <> 0 AS complete,
   coalesce(action IN ('opened', 'synchronize', 'reopened'), false) AS wanted FROM parsed)"""
_ROUTE_SQL = """SELECT event_id, CASE WHEN event_type = 'ping' THEN 'pong' WHEN event_type <> 'pull_request' THEN 'ignored' WHEN NOT wanted THEN 'skipped'
   WHEN NOT complete THEN 'error' ELSE 'ok' END AS status,
  CASE WHEN event_type = 'pull_request' AND NOT wanted THEN 'Action ''' || coalesce(action, 'None') || ''' not processed'
   WHEN event_type = 'pull_request' AND NOT complete THEN 'Missing required PR information' END AS reason,
  CASE WHEN complete THEN repo_owner || '/' || repo_name || '#' || pr_number END AS pr_id FROM routed"""


@query("event_routing", _ROUTE_SQL, ("webhook_events",), _ROUTE_CTES)
def event_routing(t):
    return events.route(t("webhook_events")).select("event_id", "status", "reason", "pr_id")


_COMMENT_SQL = f"""SELECT event_id, repo_owner || '/' || repo_name || '#' || issue_number AS pr_id, coalesce(login, 'unknown') AS reviewer, 'unknown' AS category,
  CAST(0 AS BIGINT) AS line_number, {_REPLY_CASE.replace('reply_text', "coalesce(body, '')")} AS feedback_type
 FROM parsed WHERE event_type = 'issue_comment' AND contains(html_url, 'pull_request')"""
_COMMENT_COLUMNS = ["event_id", "pr_id", "reviewer", "category", "line_number", "feedback_type"]


@query("comment_event_feedback", _COMMENT_SQL, ("webhook_events",), _ROUTE_CTES)
def comment_event_feedback(t):
    return events.comment_feedback(t("webhook_events")).select(*_COMMENT_COLUMNS)


def _feed_lines(t):
    """Feedback as lines of JSON, some of them with one fault or another."""
    n = F.col("feedback_id")
    fields = {
        "analysis_result_id": F.col("analysis_result_id"), "pr_id": F.col("pr_id"), "repo_owner": F.lit("o"), "repo_name": F.lit("r"),
        "pr_number": F.when(n % 29 == 9, F.lit("abc")).otherwise(F.col("pr_number").cast("string")),
        "feedback_type": F.when(n % 17 == 6, F.lit("great")).otherwise(F.lit("positive")),
        "source": F.when(n % 19 == 7, F.lit("fax")).otherwise(F.lit("manual")), "reviewer": F.when(n % 13 != 5, F.col("reviewer")),
        "category": F.col("category"), "file_path": F.col("file_path"), "line_number": F.when(n % 23 == 8, -1).otherwise(1),
        "metadata": F.when(n % 31 == 10, F.lit("none")).otherwise(F.lit(None)),
    }
    whole = F.regexp_replace(F.to_json(F.struct(*(v.alias(k) for k, v in fields.items()))), r'"pr_number":"(\d+)"', r'"pr_number":$1')
    line = F.when(n % 11 == 3, F.substring(whole, 1, 40)).when(n % 37 == 12, F.lit("  ")).when(n % 41 == 13, F.lit("[1, 2]")).otherwise(whole)
    return t("feedback").select("feedback_id", line.alias("value"))


_FEED_SQL = """SELECT feedback_id, reason IS NULL AS accepted, coalesce(reason, '') AS reason FROM (SELECT feedback_id,
  CASE WHEN feedback_id % 11 = 3 THEN 'Invalid JSON' WHEN feedback_id % 37 = 12 THEN 'Empty line' WHEN feedback_id % 41 = 13 THEN 'Not an object'
   WHEN feedback_id % 29 = 9 THEN 'Wrong type of pr_number' WHEN feedback_id % 13 = 5 THEN 'Missing reviewer' WHEN feedback_id % 17 = 6 THEN 'Unknown feedback_type ' || chr(39) || 'great' || chr(39)
   WHEN feedback_id % 19 = 7 THEN 'Unknown source ' || chr(39) || 'fax' || chr(39) WHEN feedback_id % 23 = 8 THEN 'Negative line_number' WHEN feedback_id % 31 = 10 THEN 'Wrong type of an optional field' END AS reason
  FROM feedback) f"""


def _both_outputs(t, folder, checked):
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in checked.schema.fields)
    good = feeds.accepted(t.spark, folder, schema).select("feedback_id", F.lit(True).alias("accepted"), F.lit("").alias("reason"))
    return good.unionByName(feeds.rejected(t.spark, folder, schema).select("feedback_id", F.lit(False).alias("accepted"), "reason"))


@query("feedback_feed", _FEED_SQL, ("feedback",))
def feedback_feed(t):
    """What a feed accepts and what it rejects and why, read back from where one pass has put them."""
    checked, folder = feeds.checked_feedback(_feed_lines(t)), new_dir(t.spark, "feed")
    feeds.split_table(checked, folder)
    return _both_outputs(t, folder, checked)


@query("stream_feedback_feed", _FEED_SQL, ("feedback",))
def stream_feedback_feed(t):
    checked, folder = feeds.checked_feedback(_stored(t, _feed_lines(t), "lines")), new_dir(t.spark, "feed")
    feeds.split_stream(checked, f"{folder}/rows", f"{folder}/checkpoint").awaitTermination()
    return _both_outputs(t, f"{folder}/rows", checked)


@query("event_quarantine", """SELECT event_id, CASE WHEN event_id % 7 <> 5 AND event_id % 9 = 4 THEN 'Missing event type' WHEN event_id % 7 = 5 THEN 'Invalid JSON' ELSE 'Missing required PR information' END AS reason
 FROM routed WHERE event_id % 7 = 5 OR event_id % 9 = 4 OR (event_type = 'pull_request' AND wanted AND NOT complete)""", ("webhook_events",), _ROUTE_CTES)
def event_quarantine(t):
    """Events that cannot be processed: cut off, without a type, or without what names a pull request."""
    n = F.col("event_id")
    rows = t("webhook_events").withColumns({
        "payload": F.when(n % 7 == 5, F.expr("substring(payload, 1, length(payload) - 3)")).otherwise(F.col("payload")),
        "event_type": F.when((n % 7 == 5) | (n % 9 != 4), F.col("event_type"))})
    checked, folder = feeds.checked_events(rows), new_dir(t.spark, "events")
    feeds.split_table(checked, folder)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in checked.schema.fields)
    return feeds.rejected(t.spark, folder, schema).select("event_id", "reason")


def _session_sql(gap: str) -> str:
    return f"""SELECT analysis_result_id, strftime(min(feedback_ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(feedback_ts) + INTERVAL {gap}, '%Y-%m-%d %H:%M:%S') AS "end",
  count(*) AS total_count, count(*) FILTER (feedback_type = 'positive') AS positive_count, count(*) FILTER (feedback_type = 'negative') AS negative_count,
  count(*) FILTER (feedback_type = 'neutral') AS neutral_count, count(*) FILTER (feedback_type = 'correction') AS correction_count
 FROM (SELECT *, sum(CASE WHEN prev IS NULL OR feedback_ts >= prev + INTERVAL {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY analysis_result_id ORDER BY feedback_ts, feedback_id) AS s
  FROM (SELECT *, lag(feedback_ts) OVER (PARTITION BY analysis_result_id ORDER BY feedback_ts, feedback_id) AS prev FROM fb) a) b GROUP BY analysis_result_id, s"""


@query("feedback_sessions_30d", _session_sql("30 DAY"), ("feedback",), FEEDBACK_SQL)
def feedback_sessions_30d(t):
    return counters.sessions(feedback_of(t))


@query("feedback_sessions_36h", _session_sql("36 HOUR"), ("feedback",), FEEDBACK_SQL)
def feedback_sessions_36h(t):
    return counters.sessions(feedback_of(t), "36 hours")


def _sliding_sql(days: int, extra: str = "") -> str:
    return f"""SELECT strftime(d - {days} + 1, '%Y-%m-%d 00:00:00') AS start, strftime(d + 1, '%Y-%m-%d 00:00:00') AS "end", category, feedback_type, count(*) AS feedback_count
 FROM (SELECT category, feedback_type, feedback_ts::DATE + CAST(i AS INTEGER) AS d FROM fb, range({days}) r(i)) x {extra} GROUP BY ALL"""


@query("feedback_sliding_counts", _sliding_sql(30), ("feedback",), FEEDBACK_SQL)
def feedback_sliding_counts(t):
    return counters.sliding_counts(feedback_of(t))


def _stored(t, df, name):
    """Derived rows written to the shared folder and streamed from there."""
    folder = new_dir(t.spark, name)
    df.write.parquet(folder)
    return t.spark.readStream.schema(t.spark.read.parquet(folder).schema).parquet(folder)


def _feedback_stream(t):
    return _stored(t, feedback_of(t).select("id", "analysis_result_id", "feedback_type", "category", "ts"), "feedback")


@query("stream_event_routing", _ROUTE_SQL, ("webhook_events",), _ROUTE_CTES)
def stream_event_routing(t):
    s = events.route(_stored(t, t("webhook_events"), "webhooks")).select("event_id", "status", "reason", "pr_id")
    return sinks.collect_append(s, "routed")


@query("stream_comment_feedback", _COMMENT_SQL, ("webhook_events",), _ROUTE_CTES)
def stream_comment_feedback(t):
    s = events.comment_feedback(_stored(t, t("webhook_events"), "webhooks")).select(*_COMMENT_COLUMNS)
    return sinks.collect_append(s, "comments")


_FILE_RULES = [r.rule_id for r in BOOK.rules if r.rule_id not in ("circular_dependency", "missing_tests")]


@query("stream_file_rules", f"SELECT pr_id, {FINDING_SQL} FROM ({R.described(' UNION ALL '.join(R.rule_rows(r)[1] for r in _FILE_RULES))}) d",
       ("file_diffs",), R.shared(["fd", "numbered", "added"]))
def stream_file_rules(t):
    """Every rule that looks at one file, as a plain streaming projection."""
    s = scan(_stored(t, t("file_diffs"), "diffs"), BOOK, BOOK.only(*_FILE_RULES))
    return BOOK.describe(sinks.collect_append(s, "findings")).select(*FINDING_COLUMNS)


@query("stream_review", f"SELECT pr_id, rank, file_path, {_RANK_SQL} FROM ranked", ("file_diffs",), _RANKED)
def stream_review(t):
    s = _stored(t, t("file_diffs"), "diffs")
    return sinks.collect_reviews(s, "reviews").select(
        "pr_id", "rank", "file_path", "line_start", BOOK.lookup("rule_id").alias("rule_id"), "confidence", "score")


@query("stream_feedback_sessions", f"SELECT * FROM ({_session_sql('36 HOUR')}) s WHERE \"end\" <= (SELECT strftime(max(feedback_ts) - INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') FROM fb)",
       ("feedback",), FEEDBACK_SQL)
def stream_feedback_sessions(t):
    """Sessions closed by the watermark at the end of the input."""
    return sinks.collect_append(counters.sessions(_feedback_stream(t), "36 hours", "1 hour"), "sessions")


def _arrivals(t, df, column, n=3):
    """Rows in ``n`` parts by time, oldest first."""
    first, last = df.agg(F.min(F.unix_micros(column)), F.max(F.unix_micros(column))).first()
    part = F.least(F.lit(n - 1), F.floor(n * (F.unix_micros(column) - first) / max(1, last - first)))
    return [df.where(part == k) for k in range(n)]


def _over_arrivals(t, name, run):
    """The feedback in three arrivals; ``run`` takes the stream up again after each. Returns the folder it writes to."""
    folder = new_dir(t.spark, name)
    rows = counters.timed(feedback_of(t).select("analysis_result_id", "feedback_type", "ts"))
    for part in _arrivals(t, rows, "ts"):
        part.write.mode("append").parquet(f"{folder}/in")
        run(t.spark.readStream.schema(rows.schema).parquet(f"{folder}/in"), folder).awaitTermination()
    return folder


@query("stream_kept_sessions", f"SELECT * FROM ({_session_sql('36 HOUR')}) s WHERE \"end\" <= (SELECT strftime(max(feedback_ts) - INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') FROM fb)",
       ("feedback",), FEEDBACK_SQL)
def stream_kept_sessions(t):
    """Sessions kept as state with timers, over three arrivals and as many starts of the stream."""
    ended = {}

    def run(stream, folder):
        out = expiring.kept_sessions(stream, "36 hours", "1 hour")
        ended["schema"] = out.schema
        return sinks.append_table(out, f"{folder}/rows", f"{folder}/checkpoint")

    with expiring.rocks_state(t.spark):
        folder = _over_arrivals(t, "kept-sessions", run)
    return t.spark.read.schema(ended["schema"]).parquet(f"{folder}/rows")


@query("stream_renewed_counts", """SELECT analysis_result_id, total_feedback AS total_count, positive_count, negative_count, neutral_count, correction_count FROM stats""",
       ("feedback",), FEEDBACK_SQL + ",\n" + STATS_SQL)
def stream_renewed_counts(t):
    """Counters kept for 30 days after their last write by the clock; all are written within that time here."""
    def run(stream, folder):
        return sinks.batch_table(expiring.renewed_counts(stream), f"{folder}/rows", f"{folder}/checkpoint")

    with expiring.rocks_state(t.spark, by_clock=True):
        folder = _over_arrivals(t, "renewed-counts", run)
    return sinks.newest_rows(t.spark, f"{folder}/rows", f"analysis_result_id string, {expiring.COUNT_SCHEMA}", ["analysis_result_id"])


@query("stream_sliding_counts", f"SELECT * FROM ({_sliding_sql(7)}) s WHERE \"end\" <= (SELECT strftime(max(feedback_ts) - INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') FROM fb)",
       ("feedback",), FEEDBACK_SQL)
def stream_sliding_counts(t):
    return sinks.collect_append(counters.sliding_counts(_feedback_stream(t), "7 days", "1 day", "1 hour"), "sliding")


@query("stream_drop_repeats", "SELECT CAST(feedback_id AS VARCHAR) AS id, analysis_result_id FROM feedback", ("feedback",))
def stream_drop_repeats(t):
    one = feedback_of(t).select("id", "analysis_result_id", "ts")
    s = counters.drop_repeats(_stored(t, one.unionByName(one), "feedback"))
    return sinks.collect_append(s.select("id", "analysis_result_id"), "distinct")


@query("stream_reviews_per_day", "SELECT strftime(ts::DATE, '%Y-%m-%d 00:00:00') AS day, count(*) AS reviews FROM events GROUP BY 1")
def stream_reviews_per_day(t):
    return sinks.collect_update(counters.per_day(t.stream("events"), "1 day"), "per_day", ["day"])


@query("reviews_per_day", "SELECT strftime(ts::DATE, '%Y-%m-%d 00:00:00') AS day, count(*) AS reviews FROM events GROUP BY 1")
def reviews_per_day(t):
    return counters.per_day(t("events"))


@query("critical_files", """SELECT DISTINCT file_path, regexp_matches(lower(file_path), 'auth|payment|security|encrypt|secret|admin|permission|access') AS critical FROM file_diffs""",
       ("file_diffs",))
def critical_files(t):
    return t("file_diffs").select("file_path", scoring.is_critical_file(F.col("file_path")).alias("critical")).distinct()


@query("feedback_multiplier", f"""SELECT category, feedback_type, n, round({_MULT}, 6) AS multiplier FROM (SELECT category, feedback_type, count(*) AS n FROM fb GROUP BY 1, 2) g""",
       ("feedback",), FEEDBACK_SQL)
def feedback_multiplier(t):
    g = feedback_of(t).groupBy("category", "feedback_type").agg(F.count("*").alias("n"))
    return g.withColumn("multiplier", scoring.feedback_multiplier(F.col("feedback_type"), F.col("n")))


# -- stored tables, loaded several times

_STORE_BUCKETS = 16


@query("stored_pr_versions", "SELECT pr_id, version_id, title, state FROM (SELECT *, row_number() OVER (PARTITION BY pr_id ORDER BY updated_at DESC, version_id DESC) AS rn FROM pr_versions) v WHERE rn = 1",
       ("pr_versions",))
def stored_pr_versions(t):
    """Late versions first, then all of them, then the late ones once more under the same number."""
    rows = t("pr_versions")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    table = StoredTable(t.spark, new_dir(t.spark, "versions"), schema, ["pr_id"], ["updated_at", "version_id"], _STORE_BUCKETS)
    late = rows.where("version_id % 2 = 1")
    for load, part in ((1, late), (2, rows), (1, late)):
        table.upsert(part, load)
    return table.read().select("pr_id", "version_id", "title", "state")


_STORED_SQL = """SELECT 'vector' AS kind, pr_id, '' AS other, round(CASE WHEN pr_number % 2 = 0 THEN e[1] ELSE e[1] / 4 END, 6) AS value FROM v
 UNION ALL SELECT 'file', pr_id, file_path, 0 FROM e
 UNION ALL SELECT 'import', file_path, dependency, 0 FROM (SELECT DISTINCT file_path, unnest(string_split(dependencies, '|')) AS dependency FROM deps) d WHERE dependency <> ''"""


@query("stored_history", _STORED_SQL, ("prs", "file_diffs", "pr_vectors"), ",\n".join([
    "v AS (SELECT pr_id, pr_number, CAST(embedding AS DOUBLE[]) AS e FROM pr_vectors)", _EDGES_SQL,
    f"""deps AS (SELECT d.file_path, coalesce(array_to_string({_DEPS_SQL}, '|'), '') AS dependencies FROM file_diffs d
 WHERE d.language = 'python' AND d.status <> 'removed' AND d.pr_id IN (SELECT pr_id FROM prs))"""]))
def stored_history(t):
    """Vectors that differ between loads, and edges of two loads that overlap, as they are read back."""
    folder = new_dir(t.spark, "history")
    table = lambda name, df: writers.history_table(t.spark, folder, name, ", ".join(
        f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields), _STORE_BUCKETS)
    given = t("pr_vectors").select("pr_id", "pr_number", "embedding")
    vectors = table("pr_embeddings", given)
    vectors.upsert(given.withColumn("embedding", F.transform("embedding", lambda x: x / F.lit(4.0).cast("float")).cast("array<float>")), 1)
    vectors.upsert(given.where("pr_number % 2 = 0"), 2)
    vectors.upsert(given.where("pr_number % 2 = 0"), 2)
    known = t("prs").select("pr_id")
    halves = [t("file_diffs").where(f"pr_number % 3 <> {k}") for k in (0, 1)]
    edges = [hist.pr_file_edges(h, known) for h in halves]
    deps = [hist.file_dep_edges(h, known) for h in halves]
    files, imports = table("pr_files", edges[0]), table("file_deps", deps[0])
    for load, (e, d) in enumerate(zip(edges, deps), 1):
        files.upsert(e, load)
        imports.upsert(d, load)
    none = F.lit(0.0)
    return vectors.read().select(F.lit("vector").alias("kind"), "pr_id", F.lit("").alias("other"), F.get("embedding", F.lit(0)).cast("double").alias("value")).unionByName(
        files.read().select(F.lit("file").alias("kind"), "pr_id", F.col("file_path").alias("other"), none.alias("value"))).unionByName(
        imports.read().select(F.lit("import").alias("kind"), F.col("src").alias("pr_id"), F.col("dst").alias("other"), none.alias("value")))


@query("upsert_vectors", "SELECT pr_id, pr_number, len(embedding) AS dimensions FROM pr_vectors", ("pr_vectors",))
def upsert_vectors(t):
    from revsieve.sources.writers import upsert_vectors as upsert

    old = t("pr_vectors").withColumn("created_at", F.lit(0))
    new = t("pr_vectors").withColumn("created_at", F.lit(1))
    return upsert(old, new).select("pr_id", "pr_number", F.size("embedding").alias("dimensions"))
