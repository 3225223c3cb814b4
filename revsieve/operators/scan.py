"""One pass over the diff table: every line, file and import hit of a file at once.

A file's hits are built as one array in the projection that reads the diff text and
unnested right after it, so the text is read once, never shuffled, and only the
narrow finding rows move on.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revsieve.functions.text import (
    added_line_imports,
    any_of,
    matches_in_line,
    none_of,
    numbered_lines,
    occurrences,
)
from revsieve.operators.catalog import RuleBook
from revsieve.operators.ranking import hashed

HIT = "struct<rule_no:int,line_start:int,arg:string,code_snippet:string,match_ord:int>"
CIRCULAR = "circular_dependency"

# Words the file rules look for.
SQL_FORMATTING = ("f'SELECT", 'f"SELECT', "+ 'SELECT", '+"SELECT')
MARKUP_LANGUAGES = ("html", "javascript", "jsx", "tsx")
ENDPOINT_WORDS = ("@app.route", "def api_", "def endpoint")
LOGGING_WORDS = ("log", "print", "console.log")
SENSITIVE_WORDS = ("password", "ssn", "credit_card", "api_key", "secret", "token")
DATABASE_WORDS = ("select", "insert", "update", "delete", "from")
API_WORDS = ("@app.route", "def get_", "def post_", "request")
BUSINESS_WORDS = ("def calculate", "def process", "def validate")
ALL_CONCERNS = "database, api, business_logic"
LARGE_CHANGE = 500
INJECTION_LANGUAGES = ("python", "java", "csharp")
DIRECT_INSTANTIATION = ("new ", "= Class(")
INTERFACE_LANGUAGES = ("python", "java", "csharp", "go")
INTERFACE_WORDS = ("interface", "protocol", "trait")
MAX_INTERFACE_METHODS = 10
CONTROLLER_PATHS = ("controller", "route", "endpoint", "api")
CONTROLLER_FORBIDDEN = ("sql", "query(", "orm.", "repository")
MODEL_PATHS = ("model", "entity", "dto", "schema")
MODEL_FORBIDDEN = ("@app.route", "def process", "def calculate")
CONTROLLER_VIOLATION = "database access in controller"
MODEL_VIOLATION = "business logic in model"
MAX_FUNCTIONS = 20
QUERY_WORDS = ("query", "get_by", "find_by", "select")
HOT_PATHS = ("api", "controller", "handler", "route")
ASYNC_WORDS = ("async def", "async function")
BLOCKING_WORDS = ("requests.get", "requests.post", "urllib", "time.sleep")
FETCH_ALL_WORDS = ("select *", "find_all", "get_all", "list()")
PAGING_WORDS = ("limit", "paginate")
PARALLEL_AWAIT = ("asyncio.gather", "asyncio.create_task")


def _no_arg() -> Column:
    return F.lit(None).cast("string")


def _file_conditions() -> dict[str, Callable[[], tuple]]:
    """Rule id to a builder of (predicate, value shown in the finding).

    Reads the columns prepared by ``_prepared``: ``d``/``dl`` the text and its lower
    case, ``pl`` the lower-case path, and the shared counts.
    """
    d, dl, pl, language = F.col("d"), F.col("dl"), F.col("pl"), F.col("language")
    loops, methods, functions = F.col("loops"), F.col("methods"), F.col("functions")

    def sensitive() -> Column:
        cases = [f"WHEN contains(dl, '{w}') THEN '{w}'" for w in SENSITIVE_WORDS]
        return F.expr(f"CASE {' '.join(cases)} END")

    def in_controller() -> Column:
        return any_of("pl", CONTROLLER_PATHS) & any_of("dl", CONTROLLER_FORBIDDEN)

    def in_model() -> Column:
        return any_of("pl", MODEL_PATHS) & any_of("dl", MODEL_FORBIDDEN)

    def violations() -> Column:
        return F.concat_ws(
            ", ", F.when(in_controller(), CONTROLLER_VIOLATION), F.when(in_model(), MODEL_VIOLATION)
        )

    def assigned_extension() -> Column:
        ext = F.substring_index("file_path", ".", -1)
        return dl.contains(F.concat(F.lit("= "), ext, F.lit(" +")))

    return {
        "sql_injection": lambda: (
            (pl.contains("sql") | (language == "sql"))
            & any_of(F.upper(d), ("SELECT", "INSERT"))
            & any_of("d", SQL_FORMATTING),
            None,
        ),
        "xss": lambda: (
            language.isin(*MARKUP_LANGUAGES)
            & d.contains("innerHTML")
            & none_of("dl", ("sanitize",)),
            None,
        ),
        "auth_bypass": lambda: (
            any_of("dl", ENDPOINT_WORDS)
            & none_of("d", ("@require_auth", "@login_required"))
            & none_of("dl", ("public", "open")),
            None,
        ),
        "sensitive_data": lambda: (
            any_of("dl", LOGGING_WORDS) & any_of("dl", SENSITIVE_WORDS),
            sensitive(),
        ),
        "separation_of_concerns": lambda: (
            any_of("dl", DATABASE_WORDS) & any_of("dl", API_WORDS) & any_of("dl", BUSINESS_WORDS),
            F.lit(ALL_CONCERNS),
        ),
        "large_change": lambda: (
            F.col("changes") > LARGE_CHANGE,
            F.col("changes").cast("string"),
        ),
        "dependency_injection": lambda: (
            language.isin(*INJECTION_LANGUAGES)
            & any_of("d", DIRECT_INSTANTIATION)
            & none_of("d", ("__init__",)),
            None,
        ),
        "interface_segregation": lambda: (
            language.isin(*INTERFACE_LANGUAGES)
            & (methods > MAX_INTERFACE_METHODS)
            & any_of("dl", INTERFACE_WORDS),
            methods.cast("string"),
        ),
        "layer_violation": lambda: (in_controller() | in_model(), violations()),
        "singleton": lambda: (dl.contains("singleton") & dl.contains("getinstance"), None),
        "god_object": lambda: (functions > MAX_FUNCTIONS, functions.cast("string")),
        "n_plus_one": lambda: (any_of("dl", ("for", "while")) & any_of("dl", QUERY_WORDS), None),
        "nested_loops": lambda: (loops >= 2, loops.cast("string")),
        "missing_index": lambda: (dl.contains("where") & none_of("dl", ("index",)), None),
        "hot_path_loop": lambda: ((loops > 0) & any_of("pl", HOT_PATHS), loops.cast("string")),
        "blocking_io": lambda: (any_of("dl", ASYNC_WORDS) & any_of("dl", BLOCKING_WORDS), None),
        "no_pagination": lambda: (
            any_of("dl", FETCH_ALL_WORDS) & none_of("dl", PAGING_WORDS),
            None,
        ),
        "nested_comprehension": lambda: (
            dl.contains("for ") & dl.contains("in ") & (occurrences("dl", "[") > 2),
            None,
        ),
        "string_concat_loop": lambda: (
            (loops > 0) & (dl.contains("+=") | assigned_extension()),
            None,
        ),
        "sequential_await": lambda: (
            (loops > 0) & dl.contains("await") & none_of("dl", PARALLEL_AWAIT),
            None,
        ),
        "missing_assertions": lambda: (
            pl.contains("test") & none_of("dl", ("assert", "expect")),
            None,
        ),
    }


def _prepared(diffs: DataFrame) -> DataFrame:
    base = diffs.select(
        "pr_id", "file_ord", "file_path", "language", "status", "changes",
        F.coalesce("diff", F.lit("")).alias("d"),
    ).withColumns({"dl": F.lower("d"), "pl": F.lower("file_path")})
    # separate steps: Spark keeps them apart because later columns use them repeatedly
    return base.withColumns({
        "loops": occurrences("dl", "for ") + occurrences("dl", "while "),
        "methods": occurrences("dl", "def ") + occurrences("dl", "func "),
    }).withColumn("functions", F.col("methods") + occurrences("dl", "function "))


def _hit(no: int, line: Column, arg: Column, snippet: Column, order: Column) -> Column:
    return F.struct(
        F.lit(no).alias("rule_no"), line.alias("line_start"), arg.alias("arg"),
        snippet.alias("code_snippet"), order.alias("match_ord"),
    )


def _file_hits(book: RuleBook, numbers: list[int]) -> tuple[Column, Column] | None:
    """An array that says which file rules apply, and the hits, made from it as column ``applies``.

    The tests are one column of a projection, which Spark compiles; inside an array function it would interpret them.
    """
    conditions = _file_conditions()
    tests, hits = [], []
    for no in numbers:
        build = conditions.get(book.rules[no - 1].rule_id)
        if build is None:
            continue
        condition, shown = build()
        shown = _no_arg() if shown is None else shown
        hits.append(F.when(F.col("applies")[len(tests)], _hit(no, F.lit(1), shown, _no_arg(), F.lit(0))))
        tests.append(condition)
    # a rule that does not apply would leave a null, and so a row
    return (F.array(*tests), F.array_compact(F.array(*hits))) if hits else None


def flagged(pattern: str) -> str:
    """Case-insensitive; a dot stops at the line feed only."""
    return f"(?id){pattern}"


def _added_lines(d: Column) -> Column:
    numbered = F.transform(
        numbered_lines(d),
        lambda l, i: F.when(l.startswith("+"), F.struct(
            (i + 1).cast("int").alias("no"), F.substring(l, 2, 2**31 - 1).alias("text"))),
    )
    return F.filter(numbered, lambda l: l.isNotNull())


def _wanted(book: RuleBook, numbers: list[int]) -> dict[str, Column]:
    """Per line rule, whether a file's text is to be matched at all."""
    language = F.coalesce("language", F.lit(""))
    readable = (F.col("status") != "removed") & ~language.isin("", "binary")

    def wanted(no: int) -> Column:
        # a plain word test on the whole text spares most files the regex
        words = book.rules[no - 1].words
        return F.coalesce(readable & any_of("dl", words) if words else readable, F.lit(False))

    return {f"_wanted{no}": wanted(no) for no in numbers if book.rules[no - 1].pattern}


def _line_hits(book: RuleBook, numbers: list[int]) -> list[Column]:
    """One array of hits per line rule over the ``added`` lines."""
    none = F.array().cast(f"array<{HIT}>")

    def hits(no: int) -> Column:
        pattern = flagged(book.rules[no - 1].pattern)

        def in_line(l: Column) -> Column:
            return F.transform(
                matches_in_line(l["text"], pattern),
                lambda m: _hit(no, l["no"], _no_arg(), m["snippet"], m["match_ord"]),
            )

        matching = F.filter("added", lambda l: l["text"].rlike(pattern))
        return F.when(F.col(f"_wanted{no}"), F.flatten(F.transform(matching, in_line))).otherwise(none)

    return [hits(no) for no in numbers if book.rules[no - 1].pattern]


def _import_hits(book: RuleBook, numbers: list[int], normalize: bool) -> Column | None:
    no = book.by_id.get(CIRCULAR)
    if no not in numbers:
        return None

    def edge(module: Column, i: Column) -> Column:
        if normalize:
            module = F.concat(F.replace(module, F.lit("."), F.lit("/")), F.lit(".py"))
        return _hit(no, F.lit(1), module, _no_arg(), i.cast("int"))

    none = F.array().cast(f"array<{HIT}>")
    return F.when(
        F.col("status") != "removed", F.transform(added_line_imports(F.col("d")), edge)
    ).otherwise(none)


def scan(diffs: DataFrame, book: RuleBook, numbers: list[int], normalize: bool = False) -> DataFrame:
    """Slim findings of the given rules plus import edges still to be paired.

    Stateless, so it works on a stream as well. Import edges carry the circular
    rule's number and the imported name; ``pair_imports`` keeps the mutual ones.
    """
    applies, file_hits = _file_hits(book, numbers) or (None, None)
    line_hits = _line_hits(book, numbers)
    parts = [file_hits, *line_hits, _import_hits(book, numbers, normalize)]
    parts = [p for p in parts if p is not None]
    wanted = _wanted(book, numbers)
    prepared = _prepared(diffs).withColumns(wanted | ({} if applies is None else {"applies": applies}))
    if line_hits:  # lines are only cut for files in which some rule looks at them
        any_wanted = reduce(lambda a, b: a | b, (F.col(name) for name in wanted))
        prepared = prepared.withColumn("added", F.when(any_wanted, _added_lines(F.col("d"))))
    # the arrays are columns of a projection, which Spark compiles; inside the generator it would interpret them.
    # Their concatenation is unnested, not a column: over a named array Spark would first filter on its size and so build every array twice
    named = prepared.select("pr_id", "file_ord", "file_path", *[p.cast(f"array<{HIT}>").alias(f"_hits{i}") for i, p in enumerate(parts)])
    none = F.array().cast(f"array<{HIT}>")
    hits = F.concat(*[F.col(f"_hits{i}") for i in range(len(parts))], none)
    return (
        named
        .select("pr_id", "file_ord", "file_path", F.inline(hits))
        .where("rule_no IS NOT NULL")
        .withColumn("confidence", book.lookup("confidence"))
    )


def pair_imports(findings: DataFrame, book: RuleBook) -> DataFrame:
    """Keep an import edge only if its pull request also holds the reverse edge.

    Both directions of an edge meet under the unordered pair of names, so one
    narrow shuffle finds them without joining the diffs to themselves. It deals by
    pull request, so that the ranking goes on from it without another one. Other
    findings pass through under a key of their own.
    """
    no = book.by_id[CIRCULAR]
    edge = F.col("rule_no") == no
    src, dst = F.col("file_path"), F.col("arg")
    keyed = findings.repartition("pr_id").withColumns({
        "_lo": F.when(edge, F.least(src, dst)).otherwise(src),
        "_hi": F.when(edge, F.greatest(src, dst)),
        "_line": F.when(edge, F.lit(0)).otherwise(F.col("line_start")),
        "_rule": F.when(edge, F.lit(0)).otherwise(F.col("rule_no")),
    })
    keys = ["pr_id", "_lo", "_hi", "_line", "_rule"]
    w = Window.partitionBy("_key", *keys)
    return (
        hashed(keyed, *keys).withColumns({
            "_out": F.max(src <= dst).over(w),
            "_back": F.max(src >= dst).over(w),
        })
        .filter(~edge | (F.col("_out") & F.col("_back")))
        .drop("_key", "_lo", "_hi", "_line", "_rule", "_out", "_back")
    )
