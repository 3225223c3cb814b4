"""Review tables derived from the driver's parquet tables.

Every statement reads whole tables and runs unchanged on Spark and, with STRING
spelled VARCHAR, on DuckDB. The driver tables hold no code, so diff text is built
from line item keys; each rule's trigger text appears at its own rate. Every line
item is a file change, and every event is feedback on a file of an existing pull request.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

_REPO_NO = "(({n}) % 1000 + CASE WHEN CAST(floor(({n}) / 1000) AS BIGINT) % 7 = 3 THEN 1 ELSE 0 END) % 20"


def _repo_no(number: str) -> str:
    return "(" + _REPO_NO.format(n=number) + ")"


def _pr_id(number: str) -> str:
    r = _repo_no(number)
    return (
        f"concat('org', CAST({r} % 5 AS STRING), '/repo', CAST({r} AS STRING), '#', "
        f"CAST({number} AS STRING))"
    )


def _path(f: str) -> str:
    return (
        f"concat(CASE ({f}) % 6 WHEN 0 THEN 'src/api/' WHEN 1 THEN 'src/models/' WHEN 2 THEN 'src/auth/' "
        f"WHEN 3 THEN 'db/sql/' WHEN 4 THEN 'tests/test_' ELSE 'lib/core/' END, 'f', CAST(({f}) AS STRING), "
        f"CASE ({f}) % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '.java' WHEN 3 THEN '.html' ELSE '.go' END)"
    )


_DIFF_LINES = [
    ("k % 11 = 0", "concat('+password = ', chr(34), 'hunter2', chr(34))"),
    ("k % 7 = 0", "'+    # TODO: fix later'"),
    ("k % 5 = 0", "'+    print(value)'"),
    ("k % 35 = 2", "'+    print(a); print(b) # FIXME: two on one line'"),
    ("k % 9 = 0", "'+    except:'"),
    ("k % 13 = 4", "'+  catch (e) { }'"),
    ("k % 37 = 5", "'+ try { try { go() } }'"),
    ("k % 17 = 6", "concat('+query = f', chr(34), 'SELECT * FROM t where id = 1', chr(34), ' # sql')"),
    ("k % 6 = 0", "'+for row in rows:'"),
    ("k % 12 = 8", "'+  while True:'"),
    ("k % 21 = 9", "'+    total += row'"),
    ("k % 14 = 10", "'+    await call(row)'"),
    ("k % 25 = 11", "'+async def fetch():'"),
    ("k % 26 = 12", "'+    requests.get(url)'"),
    ("k % 15 = 13", "'+items = get_all()'"),
    ("k % 45 = 14", "'+m = [[x for x in y] for y in [z]]'"),
    ("k % 19 = 15", "'+el.innerHTML = data'"),
    ("k % 16 = 0", "concat('+@app.route(', chr(34), '/x', chr(34), ')')"),
    ("k % 22 = 16", "'+def calculate(a):'"),
    ("k % 23 = 18", "repeat(concat('+def m(a):', chr(10)), 12)"),
    ("k % 46 = 18", "repeat(concat('+def n(a):', chr(10)), 12)"),
    ("k % 46 = 41", "'+class P(Protocol): pass'"),
    ("k % 29 = 21", "'+inst = Singleton.getInstance()'"),
    ("k % 18 = 4", "'+x = new Foo()'"),
    ("k % 20 = 3", "'+assert x == 1'"),
    ("k % 10 = 7", "'-    removed = old()'"),
    ("k % 31 = 8", "'+from pkg.mod import thing'"),
    ("k % 33 = 9", "concat('+import ', chr(34), 'lib/util', chr(34))"),
    ("k % 27 = 1", "'+function build(a) {'"),
]

_SPECIAL = {
    "import": f"CASE WHEN k % 3 = 0 THEN concat('+import ', {_path('f + 1 - 2 * (f % 2)')}) END",
}

_diff_sql = ",\n    ".join(f"CASE WHEN {cond} THEN {text} END" for cond, text in _DIFF_LINES)

_EVENT_PR = "(e.user_id * 97 + e.event_id % 20)"

# Name to (tables it reads, SQL).
INPUTS: dict[str, tuple[tuple[str, ...], str]] = {
    "file_diffs": (("lineitem",), f"""
SELECT {_pr_id('pr_number')} AS pr_id, pr_number, file_ord, {_path('f')} AS file_path,
  CASE f % 5 WHEN 0 THEN 'python' WHEN 1 THEN 'javascript' WHEN 2 THEN 'java' WHEN 3 THEN 'html' ELSE 'go' END AS language,
  CASE WHEN k % 8 = 0 THEN 'removed' WHEN l_returnflag = 'A' THEN 'added' ELSE 'modified' END AS status,
  additions, deletions, additions + deletions AS changes,
  concat_ws(chr(10), '@@ -1,3 +1,9 @@',
    {_diff_sql},
    {_SPECIAL['import']},
    ' context') AS diff
FROM (SELECT l_orderkey AS pr_number, l_returnflag, file_ord, (l_orderkey % 1000) * 8 + file_ord AS f,
   l_orderkey * 31 + l_partkey * 17 + l_linenumber AS k,
   CAST(l_quantity AS INT) * CASE WHEN l_partkey % 10 = 0 THEN 15 ELSE 1 END AS additions, l_linenumber AS deletions
   FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate,
     l_extendedprice, l_quantity, l_returnflag) AS INT) AS file_ord FROM lineitem) n) z"""),
    "prs": (("orders", "customer"), f"""
SELECT {_pr_id('o_orderkey')} AS pr_id, o_orderkey AS pr_number,
  concat('org', CAST({_repo_no('o_orderkey')} % 5 AS STRING)) AS repo_owner,
  concat('repo', CAST({_repo_no('o_orderkey')} AS STRING)) AS repo_name, c_name AS author,
  CASE o_orderstatus WHEN 'F' THEN 'closed' ELSE 'open' END AS state, o_orderpriority AS label,
  concat('Change ', CAST(o_orderkey AS STRING)) AS title,
  CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE concat('Fixes #', CAST(o_orderkey % 500 AS STRING), ' and #',
    CAST(o_orderkey % 37 AS STRING), ' and #999999') END AS description,
  o_orderdate AS created_at
FROM orders JOIN customer ON o_custkey = c_custkey"""),
    # one version per event of a pull request; the newest one counts
    "pr_versions": (("events", "orders"), f"""
SELECT {_pr_id('o_orderkey')} AS pr_id, o_orderkey AS pr_number, e.event_id AS version_id, e.ts AS updated_at,
  concat('Change ', CAST(o_orderkey AS STRING), ' v', CAST(e.event_id AS STRING)) AS title,
  CASE WHEN e.event_type = 'purchase' THEN 'closed' ELSE 'open' END AS state
FROM events e JOIN orders ON o_orderkey = {_EVENT_PR}"""),
    "commit_files": (("lineitem",), f"""
SELECT {_pr_id('l_orderkey')} AS pr_id, l_orderkey AS pr_number, l_linenumber AS commit_ord,
  md5(concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING))) AS sha,
  concat('commit ', CAST(l_linenumber AS STRING)) AS message, l_returnflag AS author, CAST(l_shipdate AS DATE) AS ts,
  {_path('l_partkey % 8000')} AS filename, CAST(l_quantity AS INT) AS additions, l_linenumber AS deletions
FROM lineitem"""),
    "issues": (("documents",), f"""
SELECT CAST(doc_id AS STRING) AS issue_id,
  concat(CASE WHEN doc_id % 5 = 0 THEN 'Error: ' ELSE '' END, 'report from ', source, ' (', lang, ') ', CAST(doc_id AS STRING)) AS title,
  text AS body, CASE doc_id % 4 WHEN 0 THEN 'bug' WHEN 1 THEN 'feature' ELSE 'docs' END AS label,
  CASE doc_id % 3 WHEN 0 THEN 'closed' ELSE 'open' END AS state FROM documents"""),
    "feedback": (("events", "file_diffs"), f"""
SELECT event_id AS feedback_id, ts AS feedback_ts, concat('u', CAST(user_id AS STRING)) AS reviewer,
  CASE event_type WHEN 'click' THEN '+1' WHEN 'error' THEN '-1' WHEN 'purchase' THEN 'heart' WHEN 'signup' THEN 'hooray' ELSE 'eyes' END AS reaction,
  d.pr_id, d.pr_number, d.file_path, category, 1 AS line_number,
  concat(category, '_', d.file_path, '_1_', md5(CASE category WHEN 'security' THEN 'Potential sensitive data in logs' WHEN 'architecture' THEN 'Potential dependency injection violation' WHEN 'performance' THEN 'Potential N+1 query pattern' ELSE 'Test may lack assertions' END)) AS analysis_result_id
FROM (SELECT *, CASE event_id % 4 WHEN 0 THEN 'security' WHEN 1 THEN 'architecture' WHEN 2 THEN 'performance' ELSE 'test' END AS category FROM events) e
LEFT JOIN (SELECT pr_number, count(*) AS files FROM file_diffs GROUP BY 1) c ON c.pr_number = {_EVENT_PR}
JOIN (SELECT pr_number % 20 AS g, min(pr_number) AS pr_number FROM file_diffs GROUP BY 1) other ON other.g = {_EVENT_PR} % 20
JOIN file_diffs d ON d.pr_number = coalesce(c.pr_number, other.pr_number) AND d.file_ord = CASE WHEN c.files IS NULL THEN 1 ELSE 1 + e.user_id % c.files END"""),
    "replies": (("conversations",), """
SELECT conv_id, turn, concat(text, CASE conv_id % 6 WHEN 0 THEN ' Thanks' WHEN 1 THEN ' this is wrong' WHEN 2 THEN ' use a list instead' WHEN 3 THEN ' I disagree' WHEN 4 THEN ' not sure' ELSE '' END) AS reply_text
FROM conversations WHERE role = 'user'"""),
    "webhook_events": (("events",), """
SELECT event_id, ts,
  CASE event_id % 10 WHEN 7 THEN 'ping' WHEN 8 THEN 'push' WHEN 9 THEN 'issue_comment' ELSE 'pull_request' END AS event_type,
  concat('{', chr(34), 'action', chr(34), ':', chr(34),
    CASE event_type WHEN 'click' THEN 'opened' WHEN 'view' THEN 'synchronize' WHEN 'signup' THEN 'reopened' WHEN 'error' THEN 'closed' ELSE 'labeled' END, chr(34),
    CASE WHEN event_id % 13 = 0 THEN '' ELSE concat(',', chr(34), 'pull_request', chr(34), ':{', chr(34), 'number', chr(34), ':', CAST(event_id AS STRING), '}') END,
    ',', chr(34), 'repository', chr(34), ':{', chr(34), 'name', chr(34), ':', chr(34), 'repo', CAST(user_id % 20 AS STRING), chr(34),
    ',', chr(34), 'owner', chr(34), ':{', chr(34), CASE WHEN event_id % 2 = 0 THEN 'login' ELSE 'name' END, chr(34), ':', chr(34), 'org', CAST(user_id % 5 AS STRING), chr(34), '}}',
    ',', chr(34), 'comment', chr(34), ':{', chr(34), 'body', chr(34), ':', chr(34), CASE event_id % 3 WHEN 0 THEN 'thanks, fixed' WHEN 1 THEN 'this is wrong' ELSE 'use a set instead' END, chr(34),
      CASE WHEN event_id % 4 = 1 THEN '' ELSE concat(',', chr(34), 'user', chr(34), ':{', chr(34), 'login', chr(34), ':', chr(34), 'u', CAST(user_id AS STRING), chr(34), '}') END, '}',
    ',', chr(34), 'issue', chr(34), ':{', chr(34), 'number', chr(34), ':', CAST(event_id AS STRING), ',', chr(34), 'html_url', chr(34), ':', chr(34), 'https://host/x/',
      CASE WHEN user_id % 3 = 0 THEN 'issues' ELSE 'pull_request' END, '/', CAST(event_id AS STRING), chr(34), '}}') AS payload
FROM events"""),
    # labels of the table act as repositories; the vector's number is its pull request
    "pr_vectors": (("embeddings",), f"""
SELECT {_pr_id('vec_id')} AS pr_id, vec_id AS pr_number, CAST(label % 4 AS STRING) AS block, embedding FROM embeddings"""),
}


def base_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table or a derived review table as a lazy DataFrame."""
    if name in BASE_TABLES:
        return base_table(spark, sf_dir, name)
    needs, sql = INPUTS[name]
    sql = sql.replace("{", "{{").replace("}", "}}")
    for need in needs:
        sql = re.sub(rf"\b(FROM|JOIN) {need}\b", rf"\1 {{{need}}}", sql)
    args = {need: table(spark, sf_dir, need) for need in needs}
    return spark.sql(sql, **args)


def duckdb_ctes(*names: str) -> str:
    """``WITH`` prefix that defines the derived tables (and what they need)."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in BASE_TABLES or name in order:
            return
        for need in INPUTS[name][0]:
            visit(need)
        order.append(name)

    for n in names:
        visit(n)
    parts = [f"{n} AS ({INPUTS[n][1].replace('STRING', 'VARCHAR')})" for n in order]
    return ",\n".join(parts)
