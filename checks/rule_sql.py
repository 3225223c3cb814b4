"""The finding rules once more, as plain SQL, to compare the Spark results with."""

from __future__ import annotations

from revsieve.operators.catalog import ANALYZER_FLOORS, RuleBook

BOOK = RuleBook.builtin()


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def any_of(col: str, words) -> str:
    return "(" + " OR ".join(f"contains({col}, {q(w)})" for w in words) + ")"


def none_of(col: str, words) -> str:
    return "NOT " + any_of(col, words)


def cnt(col: str, word: str) -> str:
    return f"CAST((length({col}) - length(replace({col}, {q(word)}, ''))) / {len(word)} AS BIGINT)"


LOOPS = f"({cnt('dl', 'for ')} + {cnt('dl', 'while ')})"
METHODS = f"({cnt('dl', 'def ')} + {cnt('dl', 'func ')})"
FUNCTIONS = f"({METHODS} + {cnt('dl', 'function ')})"
SENSITIVE = "CASE " + " ".join(
    f"WHEN contains(dl, '{w}') THEN '{w}'"
    for w in ("password", "ssn", "credit_card", "api_key", "secret", "token")
) + " END"
IN_CONTROLLER = (
    any_of("pl", ("controller", "route", "endpoint", "api"))
    + " AND " + any_of("dl", ("sql", "query(", "orm.", "repository"))
)
IN_MODEL = (
    any_of("pl", ("model", "entity", "dto", "schema"))
    + " AND " + any_of("dl", ("@app.route", "def process", "def calculate"))
)
VIOLATIONS = (
    f"concat_ws(', ', CASE WHEN {IN_CONTROLLER} THEN 'database access in controller' END, "
    f"CASE WHEN {IN_MODEL} THEN 'business logic in model' END)"
)

# rule id to (predicate, shown value)
FILE_PREDICATES = {
    "sql_injection": (
        "(contains(pl, 'sql') OR language = 'sql') AND (contains(upper(diff), 'SELECT') OR contains(upper(diff), 'INSERT')) AND "
        + any_of("diff", ("f'SELECT", 'f"SELECT', "+ 'SELECT", '+"SELECT')), "NULL"),
    "xss": ("language IN ('html','javascript','jsx','tsx') AND contains(diff, 'innerHTML') AND "
            + none_of("dl", ("sanitize",)), "NULL"),
    "auth_bypass": (
        any_of("dl", ("@app.route", "def api_", "def endpoint")) + " AND "
        + none_of("diff", ("@require_auth", "@login_required")) + " AND "
        + none_of("dl", ("public", "open")), "NULL"),
    "sensitive_data": (any_of("dl", ("log", "print", "console.log")) + f" AND {SENSITIVE} IS NOT NULL", SENSITIVE),
    "separation_of_concerns": (
        any_of("dl", ("select", "insert", "update", "delete", "from")) + " AND "
        + any_of("dl", ("@app.route", "def get_", "def post_", "request")) + " AND "
        + any_of("dl", ("def calculate", "def process", "def validate")),
        "'database, api, business_logic'"),
    "large_change": ("changes > 500", "CAST(changes AS VARCHAR)"),
    "dependency_injection": (
        "language IN ('python','java','csharp') AND " + any_of("diff", ("new ", "= Class("))
        + " AND NOT contains(diff, '__init__')", "NULL"),
    "interface_segregation": (
        f"language IN ('python','java','csharp','go') AND {METHODS} > 10 AND "
        + any_of("dl", ("interface", "protocol", "trait")), f"CAST({METHODS} AS VARCHAR)"),
    "layer_violation": (f"(({IN_CONTROLLER}) OR ({IN_MODEL}))", VIOLATIONS),
    "singleton": ("contains(dl, 'singleton') AND contains(dl, 'getinstance')", "NULL"),
    "god_object": (f"{FUNCTIONS} > 20", f"CAST({FUNCTIONS} AS VARCHAR)"),
    "n_plus_one": (any_of("dl", ("for", "while")) + " AND "
                   + any_of("dl", ("query", "get_by", "find_by", "select")), "NULL"),
    "nested_loops": (f"{LOOPS} >= 2", f"CAST({LOOPS} AS VARCHAR)"),
    "missing_index": ("contains(dl, 'where') AND NOT contains(dl, 'index')", "NULL"),
    "hot_path_loop": (any_of("pl", ("api", "controller", "handler", "route")) + f" AND {LOOPS} > 0",
                      f"CAST({LOOPS} AS VARCHAR)"),
    "blocking_io": (any_of("dl", ("async def", "async function")) + " AND "
                    + any_of("dl", ("requests.get", "requests.post", "urllib", "time.sleep")), "NULL"),
    "no_pagination": (any_of("dl", ("select *", "find_all", "get_all", "list()")) + " AND "
                      + none_of("dl", ("limit", "paginate")), "NULL"),
    "nested_comprehension": (
        f"contains(dl, '[') AND contains(dl, 'for ') AND contains(dl, 'in ') AND {cnt('dl', '[')} > 2", "NULL"),
    "string_concat_loop": (
        "(contains(dl, 'for ') OR contains(dl, 'while ')) AND (contains(dl, '+=') OR "
        "contains(dl, '= ' || string_split(file_path, '.')[-1] || ' +'))", "NULL"),
    "sequential_await": (
        "contains(dl, 'await') AND (contains(dl, 'for ') OR contains(dl, 'while ')) AND "
        + none_of("dl", ("asyncio.gather", "asyncio.create_task")), "NULL"),
    "missing_assertions": ("contains(pl, 'test') AND " + none_of("dl", ("assert", "expect")), "NULL"),
}

SHARED_CTES = {
    "fd": "SELECT *, lower(diff) AS dl, lower(file_path) AS pl FROM file_diffs",
    "numbered": """SELECT pr_id, file_ord, file_path, language, unnest(kept) AS l, generate_subscripts(kept, 1) AS line_start
 FROM (SELECT *, list_filter(string_split(diff, chr(10)), lambda l: NOT (starts_with(l, '---') OR starts_with(l, '+++')
   OR starts_with(l, '@@') OR starts_with(l, 'diff') OR starts_with(l, '-'))) AS kept FROM file_diffs
   WHERE status <> 'removed' AND coalesce(language, '') NOT IN ('', 'binary')) k""",
    "added": "SELECT pr_id, file_ord, file_path, line_start, substring(l, 2) AS content FROM numbered WHERE starts_with(l, '+')",
    "edges": """SELECT pr_id, file_ord, file_path, imp, pos FROM (
   SELECT pr_id, file_ord, file_path, unnest(imps) AS imp, generate_subscripts(imps, 1) - 1 AS pos FROM (
    SELECT pr_id, file_ord, file_path, list_transform(
      list_filter(string_split(diff, chr(10)), lambda l: starts_with(l, '+') AND contains(l, 'import')),
      lambda l: CASE WHEN contains(l, 'from')
        THEN trim(replace(replace(string_split(l, 'import')[1], '+', ''), 'from', ''))
        ELSE trim(string_split(string_split(l, 'import')[2], ',')[1]) END) AS imps
    FROM file_diffs WHERE status <> 'removed') a) b""",
    "candidates": """SELECT *, replace(replace(file_path, '.py', ''), '.js', '') AS base FROM file_diffs
   WHERE status <> 'removed' AND NOT contains(lower(file_path), 'test') AND changes > 10""",
}


def snippet_ctes(rule_id: str, pattern: str, source: str = "added") -> str:
    """Matches of one line rule over ``source`` with their snippets."""
    return f"""SELECT * EXCLUDE (pieces, piece, st, content),
   substring(content, greatest(0, st - 20) + 1, st + length(split_part(piece, chr(2), 1)) + 20 - greatest(0, st - 20)) AS code_snippet
 FROM (SELECT *, coalesce(list_sum(list_transform(pieces[1:match_ord], lambda x: length(replace(x, chr(2), '')))), 0)::BIGINT AS st
  FROM (SELECT *, unnest(pieces) AS piece, generate_subscripts(pieces, 1) - 1 AS match_ord
   FROM (SELECT *, string_split(regexp_replace(content, {q(pattern)}, chr(1) || '\\0' || chr(2), 'gi'), chr(1)) AS pieces
    FROM {source} WHERE regexp_matches(content, {q(pattern)}, 'i')) a) b WHERE match_ord >= 1) c"""


def rule_rows(rule_id: str, book: RuleBook = BOOK) -> tuple[list[str], str]:
    """(shared CTEs needed, SELECT of slim findings) for one rule."""
    no = book.by_id[rule_id]
    rule = book.rules[no - 1]
    fixed = f"{no} AS rule_no, CAST({rule.confidence} AS DOUBLE) AS confidence"
    if rule.pattern is not None:
        inner = snippet_ctes(rule_id, rule.pattern)
        return ["numbered", "added"], (
            f"SELECT pr_id, file_ord, file_path, line_start, match_ord, NULL AS arg, code_snippet, {fixed} FROM ({inner}) m")
    if rule_id == "circular_dependency":
        return ["edges"], (
            f"SELECT pr_id, file_ord, file_path, 1 AS line_start, pos AS match_ord, imp AS arg, NULL AS code_snippet, {fixed} "
            "FROM edges e WHERE EXISTS (SELECT 1 FROM edges r WHERE r.pr_id = e.pr_id AND r.file_path = e.imp AND r.imp = e.file_path)")
    if rule_id == "missing_tests":
        return ["candidates"], (
            f"SELECT pr_id, file_ord, file_path, 1 AS line_start, 0 AS match_ord, CAST(changes AS VARCHAR) AS arg, NULL AS code_snippet, {fixed} "
            "FROM candidates c WHERE NOT EXISTS (SELECT 1 FROM file_diffs t WHERE t.pr_id = c.pr_id AND t.status <> 'removed' "
            "AND contains(lower(t.file_path), 'test') AND (contains(t.file_path, c.base) "
            "OR replace(replace(t.file_path, 'test_', ''), '_test', '') = c.base))")
    cond, arg = FILE_PREDICATES[rule_id]
    return ["fd"], (
        f"SELECT pr_id, file_ord, file_path, 1 AS line_start, 0 AS match_ord, {arg} AS arg, NULL AS code_snippet, {fixed} "
        f"FROM fd WHERE {cond}")


def described(rows: str, book: RuleBook = BOOK) -> str:
    """Attach rule constants to slim findings."""
    def case(get) -> str:
        return "CASE rule_no " + " ".join(
            f"WHEN {i} THEN {get(r)}" for i, r in enumerate(book.rules, 1)) + " END"

    def text(r) -> str:
        return f"replace(replace({q(r.description)}, '{{path}}', file_path), '{{arg}}', coalesce(arg, ''))"

    analyzers = list(book.floors)
    return f"""SELECT *, {case(lambda r: q(r.rule_id))} AS rule_id, {case(lambda r: q(r.category))} AS category,
  {case(lambda r: q(r.priority))} AS priority, {case(lambda r: q(r.title))} AS title, {case(text)} AS description,
  {case(lambda r: q(r.suggestion))} AS suggestion,
  {case(lambda r: analyzers.index(r.analyzer) * 100 + r.check_ord)} AS stage FROM ({rows}) slim"""


def shared(names) -> str:
    order = [n for n in SHARED_CTES if n in set(names)]
    return ",\n".join(f"{n} AS ({SHARED_CTES[n]})" for n in order)


def findings_ctes(min_rule_confidence: float = 0.0, book: RuleBook = BOOK, own: str = "") -> str:
    """CTEs ending in ``findings``: every rule's rows with constants and id, and the rows of ``own``, a SELECT."""
    needed, selects = [], [own] if own else []
    for i in book.numbers(min_rule_confidence):
        if book.rules[i - 1].analyzer not in ANALYZER_FLOORS:
            continue
        need, select = rule_rows(book.rules[i - 1].rule_id, book)
        needed += need
        selects.append(select)
    union = "\nUNION ALL\n".join(selects)
    return f"""{shared(needed)},
findings AS MATERIALIZED (SELECT *, concat_ws('_', category, file_path, CAST(line_start AS VARCHAR), md5(title)) AS analysis_result_id
 FROM ({described(union, book)}) d)"""


SCORE = """(CASE category WHEN 'security' THEN 10.0::DOUBLE WHEN 'bug' THEN 8.0 WHEN 'business_logic' THEN 7.0 WHEN 'architecture' THEN 6.0
  WHEN 'performance' THEN 5.0 WHEN 'test' THEN 4.0 WHEN 'code_quality' THEN 3.0 ELSE 1.0 END
 * CASE priority WHEN 'critical' THEN 10.0::DOUBLE WHEN 'high' THEN 7.0 WHEN 'medium' THEN 4.0 WHEN 'low' THEN 2.0 ELSE 1.0 END
 * confidence * CASE WHEN regexp_matches(lower(file_path), 'auth|payment|security|encrypt|secret|admin|permission|access') THEN 1.5::DOUBLE ELSE 1.0 END
 * CASE WHEN category = 'security' THEN 1.2::DOUBLE ELSE 1.0 END)"""
EMISSION = "stage, file_ord, rule_no, line_start, match_ord"


def ranked_ctes(source: str = "findings", min_confidence: float = 0.6, limit: int = 50) -> str:
    """CTEs ``scored``, ``deduped`` and ``ranked`` on top of ``source``."""
    return f"""scored AS (SELECT *, {SCORE} AS score FROM {source} WHERE confidence >= {min_confidence}),
deduped AS (SELECT * EXCLUDE (dn) FROM (SELECT *, row_number() OVER (PARTITION BY pr_id, file_path, line_start, category, left(title, 50)
   ORDER BY score DESC, {EMISSION}) AS dn FROM scored) a WHERE dn = 1),
ranked AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pr_id ORDER BY score DESC, {EMISSION}) AS rank FROM deduped) b
   WHERE rank <= {limit})"""


ADJUSTED = """CASE WHEN coalesce(total_feedback, 0) = 0 THEN confidence
  ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, confidence * 1.0::DOUBLE + (positive_ratio - 0.5::DOUBLE) * 0.2::DOUBLE)) END"""
