"""What each filter of a chain removes, in every order of the filters, and each filter's Shapley share.

1. A document fails a set of filters, written as a bit mask. The filter for copies fails a text that a smaller id holds too; the
   least id of a text comes from sums by text, so a text held by a third of all documents is one row a task.
2. *Coalitions.* For each part of the table and each subset of the filters: how many documents it removes, and how many marked ones.
3. *Steps.* What a filter removes after others is the difference of two coalitions.
4. *Shapley shares* are the solution of a least-squares problem: the sums of shares over a coalition come closest to what it removes,
   weighted by the Shapley kernel, under the constraint that all shares add up to what all filters remove. Its normal equations
   are solved in fractions. They are linear in the removals, so they are solved once for unit removals, and every part uses the solution.

Defined cases: a null text counts as empty; a null part is the empty string; rows without an id are documents but neither copies nor
originals; repeated rows count each and are no copies of each other; of several label rows for an id, a mark in any counts; labels
without a document do nothing; an empty table gives no rows; other columns are not looked at. Texts are equal if their SHA-256 is.
"""

from __future__ import annotations

import json
from fractions import Fraction
from itertools import permutations
from math import comb, factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revsieve.llm.common import documents

LETTERS = "ABCDE"
COPIES = "E"
BLANKS = r"[\x20\x09-\x0D]+"
SPREAD = 64
MOST_FILTERS = 6


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """The table with ``_text`` (never null), its words and its capital letters."""
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return df.select("*", value.alias("_text")).select(
        "*", F.array_remove(F.split("_text", BLANKS), "").alias("_words"),
        F.length(F.regexp_replace("_text", "[^A-Z]+", "")).alias("_capitals"),
    )


def text_filters() -> dict[str, Column]:
    """Failure of each filter but the one for copies, over the columns of ``measured``."""
    words = F.size("_words")
    return {
        "A": words < 100,
        "B": 100 * F.size(F.array_distinct("_words")) < 80 * words,
        "C": 100 * F.col("_capitals") > 10 * F.length("_text"),
        "D": F.col("_text").rlike(r"[#$%&*|]"),
    }


def failures(df: DataFrame, filters: dict[str, Column], doc_id: str = "doc_id", part: str = "lang") -> DataFrame:
    """Rows (id, part, mask, digest, n): documents of one id, part and text, with the filters they fail as bits."""
    mask = F.lit(0)
    for bit, failed in enumerate(filters.values()):
        mask = mask.bitwiseOR(F.when(failed, F.lit(1 << bit)).otherwise(F.lit(0)))
    rows = df.select(
        F.col(f"`{doc_id}`").cast("bigint").alias("id"), F.coalesce(F.col(f"`{part}`"), F.lit("")).alias("part"), mask.alias("mask"),
        F.unhex(F.sha2(F.col("_text").cast("binary"), 256)).alias("digest"),
    )
    return rows.groupBy("id", "part", "mask", "digest").agg(F.count(F.lit(1)).alias("n"))


def marked(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """``rows`` with the marks of their id; ``marks`` has id and 0/1 columns. Rows without an id are spread over the join."""
    names = [c for c in marks.columns if c != "id"]
    known = marks.where("id IS NOT NULL").groupBy("id").agg(*(F.max(c).alias(c) for c in names)).withColumn("_spread", F.lit(0))
    spread = F.when(F.col("id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(SPREAD))).otherwise(0).cast("int")
    out = rows.withColumn("_spread", spread).join(known, ["id", "_spread"], "left").drop("_spread")
    return out.fillna(0, names)


def with_copies(rows: DataFrame, bit: int, names: list[str]) -> DataFrame:
    """Rows (part, mask, marks, n), with ``bit`` set for documents whose text a smaller id holds."""
    sums = rows.groupBy("digest", "part", "mask", *names).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"),
        F.min("id").alias("least"), F.min_by("n", "id").alias("at_least"),
    )
    # a text has no more rows here than parts and marks together
    both = sums.withColumn("first", F.min("least").over(Window.partitionBy("digest")))
    original = F.col("unnamed") + F.when(F.col("least") == F.col("first"), F.col("at_least")).otherwise(0)
    kinds = F.array(F.struct(F.col("mask").alias("mask"), original.alias("n")),
                    F.struct(F.col("mask").bitwiseOR(F.lit(bit)).alias("mask"), (F.col("n") - original).alias("n")))
    return both.select("part", *names, F.explode(kinds).alias("kind")).select("part", *names, "kind.*").where("n > 0")


def coalitions(rows: DataFrame, n_filters: int, names: list[str]) -> DataFrame:
    """For each part and subset of the filters (as bits): documents, those removed, those removed that bear each mark."""
    cells = rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), *(F.sum(F.col(c) * F.col("n")).alias(c) for c in names))
    every = cells.withColumn("coalition", F.explode(F.sequence(F.lit(0), F.lit((1 << n_filters) - 1))))
    hit = F.col("mask").bitwiseAND(F.col("coalition")) != 0
    return every.groupBy("part", "coalition").agg(
        F.sum("n").alias("documents"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("removed"),
        *(F.sum(F.when(hit, F.col(c)).otherwise(0)).alias(c) for c in names),
    )


def solved(rows: list[list[Fraction]]) -> list[list[Fraction]]:
    """Right sides of a square system of equations after elimination; each row is the left side and all right sides."""
    n = len(rows)
    for at in range(n):
        pivot = next(k for k in range(at, n) if rows[k][at])
        rows[at], rows[pivot] = rows[pivot], rows[at]
        rows[at] = [x / rows[at][at] for x in rows[at]]
        for k in range(n):
            if k != at and rows[k][at]:
                rows[k] = [x - rows[k][at] * y for x, y in zip(rows[k], rows[at])]
    return [row[n:] for row in rows]


def shapley_weights(n: int) -> list[list[int]]:
    """For each of n filters, what the removals of each coalition count in n! times its Shapley value.

    Least squares over all coalitions but the empty and the full one, with a multiplier for the constraint.
    """
    full = (1 << n) - 1
    inside = {s: Fraction(n - 1, comb(n, k) * k * (n - k)) for s in range(1, full) for k in [s.bit_count()]}
    system = []
    for i in range(n):
        left = [2 * sum(w for s, w in inside.items() if s >> i & 1 and s >> j & 1) for j in range(n)]
        right = [2 * inside[s] if s in inside and s >> i & 1 else Fraction(0) for s in range(full + 1)]
        system.append([*map(Fraction, left), Fraction(1), *right])
    system.append([*[Fraction(1)] * n, Fraction(0), *(Fraction(s == full) for s in range(full + 1))])
    whole = [[x * factorial(n) for x in row] for row in solved(system)[:n]]
    assert all(x.denominator == 1 for row in whole for x in row)
    return [[int(x) for x in row] for row in whole]


def steps(table: DataFrame, letters: str, names: list[str]) -> DataFrame:
    """One row for each part, order of the filters and step, from the coalitions' removals."""
    n, full = len(letters), (1 << len(letters)) - 1
    orders = [
        {"filter_order": "".join(o), "step": k + 1, "at": letters.index(o[k]), "before": sum(1 << letters.index(c) for c in o[:k])}
        for o in permutations(letters) for k in range(n)
    ]
    each = F.from_json(F.lit(json.dumps(orders)), "array<struct<filter_order: string, step: int, at: int, before: int>>")
    values = ["removed", *names]
    wide = table.groupBy("part").agg(
        F.max("documents").alias("documents"), F.sort_array(F.collect_list(F.struct("coalition", *values))).alias("v"))
    shares = F.array(*(
        F.aggregate(F.zip_with(F.col("v.removed"), F.array(*map(F.lit, weights)), lambda x, w: x * w), F.lit(0).cast("bigint"), lambda a, x: a + x)
        for weights in shapley_weights(n)
    ))
    rows = wide.select("part", "documents", "v", shares.alias("shares"), F.explode(each).alias("o")).select("part", "documents", "v", "shares", "o.*")

    def removed(name: str, coalition: Column) -> Column:
        return F.get(F.col(f"v.{name}"), coalition)

    bit = F.call_function("shiftleft", F.lit(1), F.col("at"))
    after = F.col("before").bitwiseOR(bit)
    here = {c: removed(c, after) - removed(c, F.col("before")) for c in values}
    return rows.select(
        "part", "filter_order", "step", (F.col("documents") - removed("removed", after)).alias("kept"), here["removed"].alias("removed"),
        (removed("removed", bit) - here["removed"]).alias("redundant"),
        (removed("removed", F.lit(full)) - removed("removed", F.lit(full) - bit)).alias("unique_fails"),
        *(here[c].alias(c) for c in names), F.get("shares", F.col("at")).alias("shapley"),
    )


def audit(
    df: DataFrame, filters: dict[str, Column], marks: DataFrame, copies: str = COPIES, doc_id: str = "doc_id", part: str = "lang",
) -> DataFrame:
    """Steps of all orders of ``filters`` and the filter ``copies``. Filters have names of one letter.

    ``df`` has the column ``_text``; ``marks`` has ``id`` and columns of 0 and 1, whose removed documents are counted under their names.
    """
    if len(filters) >= MOST_FILTERS:
        raise ValueError(f"{len(filters) + 1} filters have too many orders; {MOST_FILTERS} at most")
    names = [c for c in marks.columns if c != "id"]
    rows = with_copies(marked(failures(df, filters, doc_id, part), marks), 1 << len(filters), names)
    return steps(coalitions(rows, len(filters) + 1, names), "".join(filters) + copies, names)


def marks_of(labels: DataFrame) -> DataFrame:
    """Good and toxic documents of the labels table."""
    return labels.select(
        F.col("doc_id").cast("bigint").alias("id"), F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0)).alias("good_lost"),
        F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0)).alias("toxic_lost"),
    ).where("good_lost + toxic_lost > 0")


def op13_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    return audit(measured(docs), text_filters(), marks_of(spark.read.parquet(f"{sf_dir}/labels.parquet")))


OP13_SQL = """WITH RECURSIVE word AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
least AS (SELECT t, min(doc_id) AS first FROM word GROUP BY t),
mark AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id),
doc AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(w) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > first THEN 16 ELSE 0 END AS mask
  FROM word JOIN least USING (t) LEFT JOIN mark USING (doc_id)),
cell AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM doc GROUP BY 1, 2),
perm AS (SELECT '' AS p UNION ALL SELECT p || l FROM perm, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) x(l) WHERE position(l IN p) = 0),
step AS (SELECT p, s, (1 << (ascii(p[s]) - 65)) AS bit, list_sum([0] || [1 << (ascii(c) - 65) FOR c IN string_split(p[1:s - 1], '') IF c <> ''])::INT AS before
  FROM perm, range(1, 6) r(s) WHERE length(p) = 5),
out AS (SELECT part, p, s, bit, sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS alone,
    sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good,
    sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic
  FROM cell, step GROUP BY 1, 2, 3, 4)
SELECT part, p AS filter_order, s::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  alone::BIGINT AS unique_fails, good::BIGINT AS good_lost, toxic::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM out"""
