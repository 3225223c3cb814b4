"""Quality rules with cross-document line frequency.

Lines are normalised (lower case, blanks collapsed, digits as 0) and hashed to 128 bits. For each host, the distinct
documents that hold a line are counted, copies of equal text among them; rows that repeat id and text count once. A line is over
the limit if more than ``max(least, share * documents of the host)`` documents hold it. Lines over the limit are removed from
every document but the one with the smallest id and its copies; a document that has less
than ``left`` of its words after that is rejected, and so is one that fails the base rules. So exact copies stay for deduplication.

One pass in Arrow batches reads the texts and leaves narrow rows, which are written once. Counts are pre-aggregated
before each shuffle and keyed by (host, line, text) and (host, line), so that neither a hot host nor a hot line
gathers its documents in one task. Rows that hold hot lines meet the small table of lines over the limit in a join
that adaptive execution can split. ``apply_rules`` sends that table, whose rows are counted first, to one more pass over the texts, which
stay where they are; only if it is large do the texts that lose lines or go meet their verdicts in a join.

Defined cases: null or empty texts have no words and fail the base rules; a null host is a host of its own; a null id
comes before all others; repeated rows count once and get the same verdict; other columns pass through.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revsieve.llm.common import columns, documents, fresh, pieces, share as share_of, ship
from revsieve.plans.lineage import cut

ship(__name__)

LEAST = 20
SHARE = 0.002
LEFT = 0.3
MIN_WORDS = 50
MAX_REPEATED_PCT = 50
BROADCAST_ROWS = 100_000
SYMBOLS = b"#*$%&|<>"
DIGITS = bytes.maketrans(b"123456789", b"000000000")


def line_key(words: list[bytes]) -> bytes:
    """128 bits for a line's normal form."""
    normal = b" ".join(words).decode().lower().encode().translate(DIGITS)
    return hashlib.blake2b(normal, digest_size=16).digest()


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of three words that occur at least twice."""
    windows = list(zip(words, words[1:], words[2:]))
    seen = Counter(windows)
    if len(seen) == len(windows):
        return 0
    covered, upto = 0, 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered += i + 3 - max(i, upto)
            upto = i + 3
    return covered


def measures(text: str | None) -> tuple[int, int, int, int, int, list[tuple[bytes, int]]]:
    """Words, characters in words, symbols, repeated lines, repeated words, and (line, words in all its places)."""
    data = (text or "").encode()
    words = data.split()
    earlier, repeated, lines = set(), 0, {}
    for line in data.split(b"\n"):
        own = line.split()
        if own:
            repeated += line in earlier
            earlier.add(line)
            key = line_key(own)
            lines[key] = lines.get(key, 0) + len(own)
    chars = len(b"".join(words).decode())
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    return len(words), chars, symbols, repeated, repeated_words(words), list(lines.items())


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
LINE_TYPE = pa.list_(pa.struct([("line", pa.binary()), ("words", pa.int64())]))


def measured(df: DataFrame, text: str, host: str, doc_id: str) -> DataFrame:
    """One narrow row a document: id, host, digest of the text, measures and lines. Written once and read again."""
    narrow = df.select(
        F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{host}`").cast("string").alias("host"),
        F.unhex(F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary"))).alias("text_key"), F.col(f"`{text}`").alias("text"),
    )

    def run(batches):
        for batch in pieces(batches):
            *numbers, lines = zip(*map(measures, batch.column(3).to_pylist()))
            lists = [[{"line": k, "words": n} for k, n in own] for own in lines]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], *(pa.array(n, pa.int64()) for n in numbers), pa.array(lists, LINE_TYPE)],
                ["doc_id", "host", "text_key", *MEASURES, "lines"],
            )

    kinds = ", ".join(f"{m} bigint" for m in MEASURES)
    schema = f"doc_id bigint, host string, text_key binary, {kinds}, lines array<struct<line: binary, words: bigint>>"
    return cut(narrow.mapInArrow(run, schema))


def host_key(host: Column) -> Column:
    """Equal for equal hosts, and a value of its own for null."""
    return F.coalesce(F.concat(F.lit("="), host), F.lit("null"))


def lines_held(rows: DataFrame) -> DataFrame:
    """(host_key, line, text_key, docs, first_doc, words) of each text's lines, from ``measured`` rows."""
    rows = rows.withColumn("host_key", host_key(F.col("host"))).withColumn("id", F.coalesce(F.col("doc_id"), F.lit(-(2**63))))
    times = rows.groupBy("host_key", "text_key", "id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    twice = times.groupBy("host_key", "text_key").agg(F.sum(F.col("n") - 1).alias("repeats"))
    held = (
        rows.select("host_key", "text_key", "id", F.explode("lines").alias("l"))
        .groupBy("host_key", F.col("l.line").alias("line"), "text_key")
        .agg(F.count(F.lit(1)).alias("docs"), F.min("id").alias("first_doc"), F.max("l.words").alias("words"))
    )
    if twice.isEmpty():
        return held
    return held.join(twice, ["host_key", "text_key"], "left").withColumn("docs", F.col("docs") - F.coalesce("repeats", F.lit(0))).drop("repeats")


def over_limit(rows: DataFrame, held: DataFrame, least: int, share: float) -> DataFrame:
    """(host_key, line, first_text) of lines over the limit; the text that holds it first keeps it."""
    often = (
        held.groupBy("host_key", "line")
        .agg(F.sum("docs").alias("n"), F.min(F.struct("first_doc", "text_key")).alias("first"))
        .where(F.col("n") > least)
    )
    docs = rows.select(host_key(F.col("host")).alias("host_key"), "text_key", "doc_id").distinct()
    hosts = docs.groupBy("host_key").agg(F.count(F.lit(1)).alias("docs"))
    over = often.join(hosts, "host_key").where(F.col("n") > F.col("docs") * share)
    return over.select("host_key", "line", F.col("first.text_key").alias("first_text"))


def base_failed(n_words, n_repeat_words):
    """Of numbers or of columns."""
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEATED_PCT * n_words)


def verdicts(
    df: DataFrame, text: str = "text", host: str = "source", doc_id: str = "doc_id",
    least: int = LEAST, share: float = SHARE, left: float = LEFT,
) -> DataFrame:
    """One row a document: measures, words and lines removed, ``base_failed`` and ``kept``."""
    rows = measured(df, text, host, doc_id)
    held = lines_held(rows)
    return judged(rows, held, over_limit(rows, held, least, share), left)


def judged(rows: DataFrame, held: DataFrame, over: DataFrame, left: float) -> DataFrame:
    """The verdicts, by joins of narrow rows."""
    gone = held.join(over, ["host_key", "line"]).where(F.col("text_key") != F.col("first_text")).groupBy("host_key", "text_key").agg(
        F.sum("words").alias("words_removed"), F.collect_set("line").alias("lines_removed"))
    joined = rows.drop("lines").withColumn("host_key", host_key(F.col("host"))).join(gone, ["host_key", "text_key"], "left")
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    removed = F.coalesce(F.col("words_removed"), F.lit(0))
    return joined.select(
        "doc_id", "host", "text_key", *MEASURES, removed.alias("n_words_removed"), "lines_removed", failed.alias("base_failed"),
        (~failed & (F.col("n_words") - removed >= left * F.col("n_words"))).alias("kept"),
    )


def without_lines(df: DataFrame, text: str, lines: str) -> DataFrame:
    """The table with the lines named by column ``lines`` taken out of the texts; that column goes."""
    schema = df.drop(lines).schema

    def run(batches):
        for batch in pieces(batches):
            names = batch.schema.names
            at, of = names.index(text), names.index(lines)
            texts = []
            for value, gone in zip(batch.column(at).to_pylist(), batch.column(of).to_pylist()):
                if value and gone:
                    gone = set(gone)
                    value = "\n".join(x for x in value.split("\n") if not (w := x.encode().split()) or line_key(w) not in gone)
                texts.append(value)
            columns = [*batch.columns]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([c for i, c in enumerate(columns) if i != of], [n for i, n in enumerate(names) if i != of])

    return df.mapInArrow(run, schema)


def with_sent_lines(df: DataFrame, over: dict[str, dict[bytes, bytes]], text: str, host: str, left: float) -> DataFrame:
    """The documents that pass, without their lines over the limit, in one pass; ``over`` gives for each host its lines and who keeps them."""
    sent = share_of(df.sparkSession, over)
    (named,) = fresh(df, "_host")

    def run(batches):
        lines_of = sent()
        for batch in pieces(batches):
            at, texts, kept = batch.schema.get_field_index(text), [], []
            for value, key in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                data = (value or "").encode()
                words = data.split()
                keep = not base_failed(len(words), repeated_words(words))
                limited = lines_of.get(key)
                if keep and limited:
                    own, gone, left_over = hashlib.md5(data).digest(), 0, []
                    for line in value.split("\n"):
                        w = line.encode().split()
                        if w and limited.get(line_key(w), own) != own:
                            gone += len(w)
                        else:
                            left_over.append(line)
                    keep = len(words) - gone >= left * len(words)
                    value = "\n".join(left_over)
                texts.append(value)
                kept.append(keep)
            columns = [*batch.columns][:-1]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1]).filter(pa.array(kept, pa.bool_()))

    return df.withColumn(named, host_key(F.col(f"`{host}`").cast("string"))).mapInArrow(run, df.schema)


def apply_rules(
    df: DataFrame, text: str = "text", host: str = "source", doc_id: str = "doc_id",
    least: int = LEAST, share: float = SHARE, left: float = LEFT,
) -> DataFrame:
    """The documents that pass, without their lines over the limit; all columns of the input.

    The lines over the limit are sent to all tasks if their counted rows are few. Else the verdicts of texts that lose lines
    or go are joined with the texts.
    """
    rows = measured(df, text, host, doc_id)
    held = lines_held(rows)
    over = cut(over_limit(rows, held, least, share))
    if over.count() <= BROADCAST_ROWS:
        lines_of: dict[str, dict[bytes, bytes]] = {}
        for name, line, first in over.collect():
            lines_of.setdefault(name, {})[bytes(line)] = bytes(first)
        return with_sent_lines(df, lines_of, text, host, left)
    found = judged(rows, held, over, left)
    at_host, at_text, passed, lines = fresh(df, "_host", "_text", "_kept", "_lines")
    marked = (
        found.where(~F.col("kept") | F.col("lines_removed").isNotNull())
        .groupBy(host_key(F.col("host")).alias(at_host), F.col("text_key").alias(at_text))
        .agg(F.first("kept").alias(passed), F.first("lines_removed").alias(lines))
    )
    keyed = df.withColumns({
        at_host: host_key(F.col(f"`{host}`").cast("string")),
        at_text: F.unhex(F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary"))),
    })
    kept = keyed.join(marked, [at_host, at_text], "left").where(F.coalesce(F.col(passed), F.lit(True)))
    return without_lines(kept.select(*columns(df), lines), text, lines)


def op10_line_frequency_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = verdicts(documents(spark, sf_dir))
    return found.select("doc_id", *MEASURES, "base_failed", "kept", "n_words_removed")
