"""Text expressions over diffs: word tests, counts, lines, matches and imports."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode noncharacters: never assigned, so they can bracket a match inside a line.
OPEN, CLOSE = "﷐", "﷑"


def unmarked(col: Column) -> Column:
    """The text with marker characters of its own replaced, so that none is taken for ours."""
    return F.when(col.contains(OPEN) | col.contains(CLOSE), F.translate(col, OPEN + CLOSE, "\ufffd\ufffd")).otherwise(col)


# A diff line starting with one of these is a header and has no line number.
DIFF_HEADERS = ("---", "+++", "@@", "diff")


def sql_text(value: str) -> str:
    """A Python string as a SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def any_of(col: Column | str, words: Iterable[str]) -> Column:
    """Whether a text holds one of the words; a column name is built in one call."""
    words = list(words)
    words = [w for w in words if not any(o != w and o in w for o in words)]  # a text that holds a word holds its parts
    if isinstance(col, str):
        return F.expr(" OR ".join(f"contains({col}, {sql_text(w)})" for w in words))
    first, *others = [col.contains(w) for w in words]
    return reduce(lambda a, b: a | b, others, first)


def none_of(col: Column | str, words: Iterable[str]) -> Column:
    return ~any_of(col, words)


def occurrences(col: str, needle: str) -> Column:
    """Non-overlapping occurrences of a literal in the named column."""
    n = len(needle.encode())  # bytes: characters would have to be counted
    text = sql_text(needle)  # most texts have none, and a plain test is cheaper than a replacement
    return F.expr(f"CASE WHEN NOT contains({col}, {text}) THEN 0 ELSE CAST((octet_length({col}) - octet_length(replace({col}, {text}, ''))) / {n} AS INT) END")


def strip(col: Column) -> Column:
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def lines(col: Column) -> Column:
    return F.split(col, "\n", -1)


def numbered_lines(diff: Column) -> Column:
    """Lines that exist after the change, in order: no headers and no removed lines.

    The position in this array (from 1) is the line number findings report.
    """
    return F.filter(lines(diff), is_numbered)


def is_numbered(line: Column) -> Column:
    """Whether a line gets a number; an added line, the most frequent one, is only compared with headers that look like it."""
    def starts(added: bool) -> Column:
        return reduce(lambda a, b: a | b, [line.startswith(h) for h in ("-", *DIFF_HEADERS) if h.startswith("+") == added])

    return F.when(line.startswith("+"), ~starts(True)).otherwise(~starts(False))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is named there."""
    return F.transform(F.array(value), use)[0]


def matches_in_line(content: Column, pattern: str) -> Column:
    """Every match as ``struct(match_ord, snippet)``.

    Matches are bracketed with marker characters and the line is split at them,
    which gives offsets without any per-row Python. The snippet shows the match
    with 20 characters on either side.
    """
    def spots(pieces: Column) -> Column:
        def spot(piece: Column, i: Column) -> Column:
            # characters before this piece = sum of the plain lengths of earlier pieces
            start = F.aggregate(F.slice(pieces, 1, i + 1), F.lit(0), lambda a, p: a + F.length(F.replace(p, F.lit(CLOSE), F.lit(""))))
            return F.struct(
                (i + 1).cast("int").alias("match_ord"), start.alias("start"),
                F.length(F.substring_index(piece, CLOSE, 1)).alias("size"),
            )

        return F.transform(F.slice(pieces, 2, F.greatest(F.lit(0), F.size(pieces) - 1)), spot)

    def build(s: Column) -> Column:
        lo = F.greatest(F.lit(0), s["start"] - 20)
        return F.struct(
            s["match_ord"].alias("match_ord"),
            F.substring(content, lo + 1, s["start"] + s["size"] + 20 - lo).alias("snippet"),
        )

    marked = F.regexp_replace(unmarked(content), pattern, f"{OPEN}$0{CLOSE}")
    return F.transform(bound(F.split(marked, OPEN, -1), spots), build)


def all_groups(text: Column, pattern: str, groups: int) -> Column:
    """First non-empty group of every match; matches without one are skipped."""
    found = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in range(1, groups + 1)]
    merged = found[0]
    for other in found[1:]:
        merged = F.zip_with(
            merged, other, lambda a, b: F.when((a.isNotNull()) & (a != ""), a).otherwise(b)
        )
    return F.filter(merged, lambda x: x.isNotNull() & (x != ""))


def issue_refs(description: Column) -> Column:
    return F.regexp_extract_all(description, F.lit(r"#(\d+)"), F.lit(1))


def pr_key(owner: Column, name: Column, number: Column) -> Column:
    return F.concat(owner, F.lit("/"), name, F.lit("#"), number.cast("string"))


def added_line_imports(diff: Column) -> Column:
    """Module names on added lines, by plain word splitting (array of strings)."""
    candidates = F.filter(
        lines(diff),
        lambda l: l.startswith("+") & l.contains("import"),
    )

    def module(line: Column) -> Column:
        before = strip(
            F.replace(
                F.replace(F.substring_index(line, "import", 1), F.lit("+"), F.lit("")),
                F.lit("from"), F.lit(""),
            )
        )
        after = strip(F.substring_index(F.element_at(F.split(line, "import", -1), 2), ",", 1))
        return F.when(line.contains("from"), before).otherwise(after)

    return F.when(diff.contains("import"), F.transform(candidates, module)).otherwise(F.when(diff.isNotNull(), F.array().cast("array<string>")))
