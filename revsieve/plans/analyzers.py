"""Analyzers brought by the user: rules as data, and a table or column function that finds them.

An analyzer's rules carry category, priority, confidence and texts like the built-in ones, so its findings are scored, deduplicated, ranked and
described with all others. One that cannot be planned or run is reported and left out; the others go on.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revsieve.operators.catalog import Rule, RuleBook
from revsieve.plans.lineage import new_dir


@dataclass(frozen=True)
class Analyzer:
    """``find`` takes the file changes and returns rows with pr_id, file_path and rule_id (one of ``rules``).

    Rows may also have line_start (else 1), file_ord, match_ord (else 0), arg, code_snippet, and a confidence, which
    is then at most that of the rule. Rules are not looked for if their confidence cannot reach a review's threshold.
    """

    name: str
    rules: tuple[Rule, ...]
    find: Callable[[DataFrame], DataFrame]
    floor: float = 0.0


def of_columns(name: str, checks: list[tuple[Rule, Callable[[], Column]]], floor: float = 0.0) -> Analyzer:
    """An analyzer whose rules are conditions on a file change, all looked for in one pass."""

    def find(diffs: DataFrame) -> DataFrame:
        hits = F.array_compact(F.array(*(F.when(condition(), F.lit(rule.rule_id)) for rule, condition in checks)))
        return diffs.select("pr_id", "file_path", "file_ord", F.explode(hits).alias("rule_id"))

    return Analyzer(name, tuple(rule for rule, _ in checks), find, floor)


def slim(found: DataFrame, analyzer: Analyzer, book: RuleBook) -> DataFrame:
    """An analyzer's rows as slim findings; a rule that is not its own is an error."""
    numbers = {r.rule_id: book.by_id[r.rule_id] for r in analyzer.rules}
    unknown = F.raise_error(F.concat(F.lit(f"{analyzer.name} has no rule "), F.coalesce("rule_id", F.lit("null"))))
    number = F.lit(None).cast("int")
    for rule_id, no in numbers.items():
        number = F.when(F.col("rule_id") == rule_id, F.lit(no)).otherwise(number)

    def given(column: str, kind: str, default) -> Column:
        value = F.col(column) if column in found.columns else F.lit(None)
        return F.coalesce(value.cast(kind), F.lit(default).cast(kind)).alias(column)

    named = found.withColumn("rule_no", F.coalesce(number, unknown.cast("int")))
    constant = book.lookup("confidence")
    confidence = F.least(F.coalesce(F.col("confidence").cast("double"), constant), constant) if "confidence" in found.columns else constant
    return named.select(
        "pr_id", given("file_ord", "int", 0), "file_path", given("line_start", "int", 1), "rule_no", given("arg", "string", None),
        given("code_snippet", "string", None), given("match_ord", "int", 0), confidence.alias("confidence"))


def run_analyzers(
    diffs: DataFrame, analyzers: list[Analyzer], book: RuleBook, numbers: list[int],
) -> tuple[list[DataFrame], list[tuple[str, str]]]:
    """Slim findings of each analyzer with a rule among ``numbers``, written out, and (name, reason) of those that failed."""
    parts, failed = [], []
    for analyzer in analyzers:
        wanted = [book.by_id[r.rule_id] for r in analyzer.rules if book.by_id[r.rule_id] in numbers]
        if not wanted:
            continue
        folder = new_dir(diffs.sparkSession, "analyzer")
        try:
            slim(analyzer.find(diffs), analyzer, book).where(F.col("rule_no").isin(wanted)).write.parquet(folder)
        except Exception as error:  # noqa: BLE001  (whatever it is, the other analyzers go on)
            reason = str(error).strip().splitlines()[0] if str(error).strip() else type(error).__name__
            failed.append((analyzer.name, reason))
            warnings.warn(f"analyzer {analyzer.name} is left out: {reason}", stacklevel=2)
            continue
        parts.append(diffs.sparkSession.read.parquet(folder))
    return parts, failed
