"""The rule book: what every finding rule says, and how to look its constants up.

Findings travel through joins and rankings as a rule number plus the few values
that differ per finding. Titles, suggestions and metadata are attached by
``describe`` once the rows to keep are known, so shuffles stay narrow.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revsieve.functions import scoring
from revsieve.functions.text import sql_text


@dataclass(frozen=True)
class Rule:
    rule_id: str
    analyzer: str
    category: str
    priority: str
    confidence: float
    title: str
    description: str  # {path} and {arg} are filled per finding
    suggestion: str
    check_ord: int = 0
    sub_ord: int = 0
    metadata: dict = field(default_factory=dict)
    arg_key: str | None = None
    pattern: str | None = None  # line rules only
    words: tuple = ()  # lower-case words of which every match holds one


# Analyzers in reporting order, each with its own confidence floor.
ANALYZER_FLOORS = {
    "pattern": 0.5,
    "security": 0.6,
    "architecture": 0.5,
    "performance": 0.5,
    "test": 0.5,
}

# Line rules (name, pattern, category, priority, confidence, message, suggestion).
LINE_RULES = (
    ("empty_catch", r"catch\s*\([^)]*\)\s*\{\s*\}", "bug", "medium", 0.7,
     "Empty catch block may hide errors",
     "Add error handling or logging in catch block"),
    ("hardcoded_secret", r"""(?:password|secret|api[_-]?key|token)\s*=\s*['"][^'"]+['"]""",
     "security", "critical", 0.8,
     "Potential hardcoded secret detected",
     "Use environment variables or secret management service"),
    ("todo_in_code", r"(?:TODO|FIXME|HACK|XXX):\s*(.+)", "code_quality", "low", 0.6,
     "TODO/FIXME comment found",
     "Consider creating an issue or addressing before merge"),
    ("print_debug", r"print\s*\([^)]+\)", "code_quality", "low", 0.5,
     "Print statement found (debug code?)",
     "Use proper logging instead of print statements"),
    ("broad_except", r"except\s*:", "bug", "medium", 0.65,
     "Bare except clause catches all exceptions",
     "Catch specific exceptions or at least log the error"),
    ("nested_try", r"try\s*\{[^}]*try\s*\{", "code_quality", "low", 0.5,
     "Nested try-catch blocks may indicate complex error handling",
     "Consider refactoring to simplify error handling"),
)

# File and relational rules, in reporting order.
FILE_RULES = (
    Rule("sql_injection", "security", "security", "high", 0.75,
         "Potential SQL injection risk",
         "SQL query appears to use string formatting with user input",
         "Use parameterized queries or ORM methods instead of string concatenation",
         1, 0, {"vulnerability_type": "sql_injection"}),
    Rule("xss", "security", "security", "medium", 0.65,
         "Potential XSS vulnerability",
         "innerHTML usage without sanitization detected",
         "Use textContent or sanitize HTML before setting innerHTML",
         2, 0, {"vulnerability_type": "xss"}),
    Rule("auth_bypass", "security", "security", "high", 0.6,
         "Endpoint may lack authentication",
         "New endpoint detected without obvious authentication decorator",
         "Verify this endpoint requires authentication. Add @require_auth or similar decorator if needed",
         3, 0, {"vulnerability_type": "auth_bypass"}),
    Rule("sensitive_data", "security", "security", "medium", 0.7,
         "Potential sensitive data in logs",
         "Found '{arg}' keyword near logging statements",
         "Ensure sensitive data is not logged. Use masking or remove from logs",
         4, 0, {"vulnerability_type": "data_exposure"}, "sensitive_type"),
    Rule("circular_dependency", "architecture", "architecture", "medium", 0.6,
         "Potential circular dependency",
         "Circular import detected between {path} and {arg}",
         "Refactor to break circular dependency. Consider dependency injection or extracting shared code",
         1, 0, {}, "circular_with"),
    Rule("separation_of_concerns", "architecture", "architecture", "medium", 0.55,
         "Potential violation of separation of concerns",
         "File appears to mix multiple concerns: {arg}",
         "Consider splitting into separate modules following single responsibility principle",
         2, 0, {}, "concerns"),
    Rule("large_change", "architecture", "architecture", "low", 0.5,
         "Large change set detected",
         "File has {arg} changes, which may indicate high complexity",
         "Consider breaking this into smaller, focused PRs for easier review",
         3, 0, {}, "change_count"),
    Rule("dependency_injection", "architecture", "architecture", "medium", 0.6,
         "Potential dependency injection violation",
         "Direct instantiation detected - consider using dependency injection",
         "Use dependency injection framework or constructor injection for better testability",
         4, 0, {"issue_type": "dependency_injection"}),
    Rule("interface_segregation", "architecture", "architecture", "low", 0.55,
         "Large interface detected",
         "Interface has {arg} methods - may violate interface segregation principle",
         "Consider splitting into smaller, focused interfaces",
         5, 0, {"issue_type": "interface_segregation"}, "method_count"),
    Rule("layer_violation", "architecture", "architecture", "medium", 0.65,
         "Architectural layer violation",
         "Detected violations: {arg}",
         "Refactor to maintain proper layer separation (Controller -> Service -> Repository -> Model)",
         6, 0, {"issue_type": "layer_violation"}, "violations"),
    Rule("singleton", "architecture", "architecture", "low", 0.5,
         "Singleton pattern detected",
         "Singleton pattern can make testing difficult and create hidden dependencies",
         "Consider using dependency injection instead of singleton",
         7, 0, {"pattern": "singleton", "issue_type": "design_pattern"}),
    Rule("god_object", "architecture", "architecture", "medium", 0.6,
         "Potential god object",
         "File has {arg} functions - may have too many responsibilities",
         "Consider splitting into smaller, focused classes/modules",
         7, 1, {"issue_type": "god_object"}, "function_count"),
    Rule("n_plus_one", "performance", "performance", "medium", 0.6,
         "Potential N+1 query pattern",
         "Database query detected inside loop, which may cause N+1 problem",
         "Consider using eager loading, batch queries, or data prefetching",
         1, 0, {"issue_type": "n_plus_one"}),
    Rule("nested_loops", "performance", "performance", "low", 0.5,
         "Nested loops detected",
         "Multiple nested loops may cause performance issues with large datasets",
         "Consider optimizing algorithm complexity or using vectorized operations",
         2, 0, {}, "loop_count"),
    Rule("missing_index", "performance", "performance", "low", 0.4,
         "Query may benefit from index",
         "WHERE clause detected - ensure appropriate indexes exist",
         "Verify database indexes exist for columns used in WHERE clauses",
         3, 0, {"issue_type": "missing_index"}),
    Rule("hot_path_loop", "performance", "performance", "medium", 0.65,
         "Potential performance regression in hot path",
         "Loop detected in API/controller layer - may impact request latency",
         "Consider moving heavy computation to background jobs or optimizing loop complexity",
         4, 0, {"risk_level": "medium"}, "loop_count"),
    Rule("blocking_io", "performance", "performance", "high", 0.7,
         "Blocking I/O in async function",
         "Synchronous I/O detected in async context - blocks event loop",
         "Use async/await compatible libraries (aiohttp, httpx) instead of blocking calls",
         4, 1, {"risk_level": "high", "issue_type": "blocking_io"}),
    Rule("no_pagination", "performance", "performance", "medium", 0.6,
         "Potential memory issue - no pagination",
         "Query fetches all records without pagination - may cause memory issues",
         "Add pagination or limit clause to prevent loading large datasets",
         4, 2, {"risk_level": "medium", "issue_type": "no_pagination"}),
    Rule("nested_comprehension", "performance", "performance", "low", 0.5,
         "Nested list comprehension detected",
         "Complex nested comprehension may consume significant memory",
         "Consider using generator expressions or breaking into multiple steps",
         5, 0, {"issue_type": "memory_usage"}),
    Rule("string_concat_loop", "performance", "performance", "medium", 0.6,
         "String concatenation in loop",
         "String concatenation in loops creates new objects each iteration",
         "Use list.join() or string builder pattern for better performance",
         5, 1, {"issue_type": "string_concat"}),
    Rule("sequential_await", "performance", "performance", "medium", 0.65,
         "Sequential await in loop",
         "Awaiting in loop processes items sequentially - may be slow",
         "Use asyncio.gather() or asyncio.create_task() for parallel processing",
         6, 0, {"issue_type": "sequential_await"}),
    Rule("missing_tests", "test", "test", "medium", 0.6,
         "No corresponding test file detected",
         "Changed file {path} doesn't appear to have corresponding tests",
         "Consider adding tests for the changed functionality",
         1, 0, {}, "changes"),
    Rule("missing_assertions", "test", "test", "medium", 0.7,
         "Test may lack assertions",
         "Test file doesn't appear to have assertions",
         "Ensure tests have proper assertions to validate behavior",
         2, 0, {"issue_type": "missing_assertions"}),
)

# A match of the rule always holds one of these, so texts without them are passed over.
LINE_RULE_WORDS = {
    "empty_catch": ("catch",),
    "hardcoded_secret": ("password", "secret", "api", "token"),
    "todo_in_code": ("todo:", "fixme:", "hack:", "xxx:"),
    "print_debug": ("print",),
    "broad_except": ("except",),
    "nested_try": ("try",),
}

# Fixed value: feedback can lift a confidence by at most this much.
MAX_FEEDBACK_LIFT = 0.1


def _literal(value) -> str:
    if isinstance(value, str):
        return sql_text(value)
    return f"{value!r}D" if isinstance(value, float) else repr(value)


def line_rule(name, pattern, category, priority, confidence, message, suggestion) -> Rule:
    return Rule(
        name, "pattern", category, priority, confidence, message,
        f"Found {name} pattern in {{path}}", suggestion,
        metadata={"pattern_name": name}, pattern=pattern,
    )


class RuleBook:
    """An ordered set of rules; a rule's number is its 1-based place in the book.

    ``floors`` has the analyzers in reporting order, each with the least confidence that it reports.
    """

    def __init__(self, rules: Iterable[Rule], floors: dict[str, float] | None = None):
        self.rules = list(rules)
        self.by_id = {r.rule_id: i for i, r in enumerate(self.rules, 1)}
        self.floors = dict(ANALYZER_FLOORS if floors is None else floors)

    @classmethod
    def builtin(cls) -> "RuleBook":
        lines = [replace(line_rule(*r), words=LINE_RULE_WORDS[r[0]]) for r in LINE_RULES]
        return cls(lines + list(FILE_RULES))

    def with_line_rules(self, custom: Iterable[Rule]) -> "RuleBook":
        """Replace line rules of the same name in place; new ones follow the others."""
        custom = {r.rule_id: r for r in custom}
        lines = [custom.pop(r.rule_id, r) for r in self.rules if r.pattern is not None]
        return RuleBook(
            lines + list(custom.values()) + [r for r in self.rules if r.pattern is None], self.floors
        )

    def with_analyzer(self, name: str, rules: Iterable[Rule], floor: float = 0.0) -> "RuleBook":
        """The rules of one more analyzer after all others."""
        rules = [replace(r, analyzer=name) for r in rules]
        known = set(self.by_id) & {r.rule_id for r in rules}
        if name in self.floors or known:
            raise ValueError(f"analyzer {name} repeats a name: {sorted(known) or name}")
        return RuleBook(self.rules + rules, self.floors | {name: floor})

    def numbers(self, min_confidence: float = 0.0, floors: bool = True) -> list[int]:
        """Rules whose findings can reach the output.

        A rule's confidence is a constant, so both the analyzer floor and the
        final threshold are settled here instead of row by row.
        """
        return [
            i for i, r in enumerate(self.rules, 1)
            if r.confidence >= min_confidence
            and (not floors or r.confidence >= self.floors[r.analyzer])
        ]

    def only(self, *rule_ids: str) -> list[int]:
        return [self.by_id[r] for r in rule_ids]

    # -- column lookups -----------------------------------------------------

    def values(self, attr) -> str:
        """SQL array literal with one value per rule."""
        get = attr if callable(attr) else lambda r: getattr(r, attr)
        return "array(" + ", ".join(_literal(get(r)) for r in self.rules) + ")"

    def lookup(self, attr) -> Column:
        """Constant of the row's rule, as an indexed literal array.

        Given as SQL text: one call builds the whole array.
        """
        return F.expr(f"element_at({self.values(attr)}, rule_no)")

    def signature(self) -> Column:
        """Number shared by rules that agree on category and first 50 title characters."""
        seen: dict = {}
        return self.lookup(
            lambda r: seen.setdefault((r.category, r.title[:50]), len(seen))
        )

    def emission_order(self) -> list[Column]:
        """Sort key equal to the order in which findings are reported.

        Analyzer and check come first, then the file. Line rules are applied file
        by file, so among them the rule's own place only counts after the file.
        """
        analyzers = list(self.floors)
        return [
            self.lookup(lambda r: analyzers.index(r.analyzer) * 100 + r.check_ord).asc(),
            F.col("file_ord").asc(),
            F.col("rule_no").asc(),
            F.col("line_start").asc(),
            F.col("match_ord").asc(),
        ]

    def finding_id(self) -> Column:
        return scoring.finding_id(
            self.lookup("category"),
            F.col("file_path"),
            F.col("line_start"),
            self.lookup(lambda r: hashlib.md5(r.title.encode()).hexdigest()),
        )

    def score(self) -> Column:
        return scoring.priority_score(
            self.lookup("category"), self.lookup("priority"),
            F.col("confidence"), F.col("file_path"),
        )

    def describe(self, findings: DataFrame) -> DataFrame:
        """Attach everything a rule says: texts, metadata and the finding id."""

        def filled(rule: Rule) -> str:
            pieces, rest = [], rule.description
            while "{" in rest:
                head, rest = rest.split("{", 1)
                token, rest = rest.split("}", 1)
                pieces += [_literal(head), "file_path" if token == "path" else "arg"]
            return "concat(" + ", ".join([*pieces, _literal(rest)]) + ")"

        def noted(rule: Rule) -> str:
            pairs = [_literal(x) for kv in rule.metadata.items() for x in kv]
            if rule.rule_id == "missing_tests":
                pairs += ["'file_path'", "file_path"]
            if rule.arg_key:
                pairs += [_literal(rule.arg_key), "arg"]
            return f"map({', '.join(pairs)})"

        def per_rule(build) -> Column:
            cases = [f"WHEN {i} THEN {build(r)}" for i, r in enumerate(self.rules, 1)]
            return F.expr(f"CASE rule_no {' '.join(cases)} END")

        return findings.withColumns({
            "rule_id": self.lookup("rule_id"),
            "analyzer": self.lookup("analyzer"),
            "category": self.lookup("category"),
            "priority": self.lookup("priority"),
            "line_end": F.col("line_start"),
            "title": self.lookup("title"),
            "description": per_rule(filled),
            "suggestion": self.lookup("suggestion"),
            "metadata": per_rule(noted),
            "analysis_result_id": self.finding_id(),
            "confidence_level": scoring.confidence_level(F.col("confidence")),
        })


def rules_from_rows(rows) -> list[Rule]:
    """Rules from rows of the ``rules`` schema (configuration, not data)."""
    return [
        line_rule(r["name"], r["pattern"], r["category"], r["priority"],
                  r["confidence"], r["message"], r["suggestion"])
        for r in rows
    ]


def merge_rule_tables(builtin: DataFrame, custom: DataFrame) -> DataFrame:
    """Custom rows override built-in rows of the same name, new names come after."""
    cols = ["pattern", "category", "priority", "confidence", "message", "suggestion"]
    b = builtin.select("name", "rule_ord", *[F.col(c).alias(f"b_{c}") for c in cols])
    u = custom.select(
        "name", F.col("rule_ord").alias("custom_ord"), F.lit(True).alias("is_custom"),
        *[F.col(c).alias(f"u_{c}") for c in cols],
    )
    return b.join(u, "name", "full_outer").select(
        "name",
        *[
            F.when(F.col("is_custom"), F.col(f"u_{c}")).otherwise(F.col(f"b_{c}")).alias(c)
            for c in cols
        ],
        F.coalesce("is_custom", F.lit(False)).alias("is_custom"),
        F.col("rule_ord").isNull().alias("is_new"),
        F.coalesce("rule_ord", "custom_ord").alias("rule_ord"),
    )
