"""Quality scores learned from preferences: Bradley-Terry ranking.

A document's strength is a linear function of measures of its text. In each preference pair, a document labelled good is
preferred to one labelled bad with probability logistic(difference of strengths); the weights minimise the logistic loss over
the differences of the measures. Strengths are then cut at a quantile of those of the training rows, the share of bad labels
in them, and mapped to 0 to 1 so that the cut is at ``CUT``.

Every labelled document takes part. They are dealt by a hash of their id to groups of about ``GROUP``, and each one of the rarer
label is paired ``PAIRS`` times within its group. A Newton step adds up each partition's slope and curvature; the quantile is found by
counting in ever narrower bins. Only such sums, and at most ``FEW`` strengths, reach the driver. Scoring reads each text once, without a shuffle. Only the
text gives measures: no label, language, source or id.

Defined cases: null and empty texts have measures of zero and get a score; labels that are null or of documents
not in the table are left out; without both kinds of labels every score is ``CUT``; repeated rows get equal scores; other
columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revsieve.llm.common import documents, held_out, pieces, schema_with, share, ship
from revsieve.plans.lineage import cut

ship(__name__)

GROUP = 256
FEW = 10_000
BINS = 1024
STEPS = 30
PAIRS = 8
CUT = 0.7
RIDGE = 1e-3
STYLE = {"bars": b"|", "calls": b"!", "marks": b"*#$%&<>~^=", "upper": bytes(range(65, 91)), "digits": bytes(range(48, 58)), "stops": b".,;:?", "quotes": b"\"'()[]{}"}
MEASURES = 16


def measures(text: str | None) -> list[float]:
    """Numbers that describe a text's form."""
    data = (text or "").encode()
    words = data.split()
    n, size = len(words), max(len(data), 1)
    if not n:
        return [0.0] * MEASURES
    lines = [x for x in data.split(b"\n") if x.strip()]
    windows = list(zip(words, words[1:], words[2:]))
    kinds = len(set(words))
    return [
        float(np.log1p(n)), sum(map(len, words)) / n, kinds / n, float(np.log1p(n / len(lines))), 1 - len(set(lines)) / len(lines),
        1 - len(set(windows)) / max(len(windows), 1), sum(len(w) <= 3 for w in words) / n, float(np.log1p(max(map(len, words)))),
        *((len(data) - len(data.translate(None, of))) / size for of in STYLE.values()), len(data.decode()) / size,
    ]


class Ranking:
    """Weights of the measures, and the place of the cut."""

    def __init__(self):
        self.middle, self.spread = np.zeros(MEASURES), np.ones(MEASURES)
        self.weights, self.cut = np.zeros(2 * MEASURES), 0.0

    def gaps(self, measured: np.ndarray, good: np.ndarray, rarer: bool, pairs: int, seed: int) -> np.ndarray:
        """Differences of features, liked less disliked, of one group's pairs; ``rarer`` is the label with fewer rows in all."""
        own, others = np.flatnonzero(good == rarer), np.flatnonzero(good != rarer)
        if not len(own) or not len(others):
            return np.empty((0, 2 * MEASURES))
        x = self.features(measured)
        longer = np.repeat(own, pairs)
        other = np.random.default_rng(seed).choice(others, len(longer))
        return x[longer] - x[other] if rarer else x[other] - x[longer]

    def sums(self, gap: np.ndarray) -> np.ndarray:
        """Number of pairs, slope and curvature of the logistic loss, as one row of numbers that add up."""
        chance = 1 / (1 + np.exp(-np.clip(gap @ self.weights, -30, 30)))
        bend = (gap * (chance * (1 - chance))[:, None]).T @ gap
        return np.concatenate([[len(gap)], gap.T @ (1 - chance), bend.ravel()])

    def step(self, total: np.ndarray) -> float:
        """A Newton step with a ridge; its largest change."""
        n, width = total[0], len(self.weights)
        slope = total[1:1 + width] / n - RIDGE * self.weights
        bend = total[1 + width:].reshape(width, width) / n + RIDGE * np.eye(width)
        change = np.linalg.solve(bend, slope)
        self.weights = self.weights + change
        return float(np.abs(change).max())

    def features(self, measured: np.ndarray) -> np.ndarray:
        """Measures in standard units, and how far each is from the middle."""
        unit = np.clip((measured - self.middle) / self.spread, -5, 5)
        return np.concatenate([unit, np.abs(unit)], axis=1)

    def strengths(self, measured: np.ndarray) -> np.ndarray:
        # summed row by row: equal texts get equal scores whatever stands beside them
        return (self.features(measured) * self.weights).sum(axis=1)

    def scores(self, measured: np.ndarray) -> np.ndarray:
        above = np.clip(self.strengths(measured) - self.cut, -500, 500)
        odds = CUT / (1 - CUT) * np.exp(above)
        return np.where(above == 0, CUT, odds / (1 + odds))


def measured(df: DataFrame, text: str, name: str) -> DataFrame:
    kept = df.drop(name)

    def run(batches):
        for batch in pieces(batches):
            found = [measures(t) for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.float64()))], [*batch.schema.names, name])

    return kept.mapInArrow(run, schema_with(kept, f"`{name}` array<double>"))


def training_rows(df: DataFrame, labels: DataFrame, text: str, doc_id: str, label: str) -> DataFrame:
    """(doc, measures, good): one row for every labelled document of the table. Texts are measured where they lie; only measures are joined."""
    chosen = labels.select(F.col(f"`{doc_id}`").alias("doc"), F.col(f"`{label}`").cast("int").alias("good")).where(
        "doc IS NOT NULL AND good IS NOT NULL").groupBy("doc").agg((F.max("good") == 1).alias("good"))
    texts = df.select(F.col(f"`{doc_id}`").alias("doc"), F.col(f"`{text}`").alias("text")).where("doc IS NOT NULL")
    rows = measured(texts, "text", "measures").drop("text").join(chosen, "doc")
    return rows.groupBy("doc").agg(F.min(F.struct("measures", "good")).alias("r")).select("doc", "r.*")


def quantile(values: DataFrame, share: float, few: int = FEW) -> float:
    """The quantile of column ``v`` as numpy's ``quantile`` has it: bins around its place are counted until few values are left."""
    n, low, high = values.agg(F.count("v"), F.min("v"), F.max("v")).first()
    place = share * (n - 1)
    first, skipped = int(place), 0
    near = values
    while low < high and n - skipped > few:
        width = (high - low) / BINS
        if low + width == low:
            break
        at = F.least(F.floor((F.col("v") - low) / width), F.lit(BINS - 1))
        bins = sorted(near.groupBy(at.alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect())
        below = skipped
        for k, b in enumerate(bins):
            if first < below + b["n"]:
                break
            below += b["n"]
        # the next larger value may be the least of the bin after
        above = bins[k + 1]["low"] if first + 1 == below + b["n"] and k + 1 < len(bins) else None
        if above is not None:
            return b["high"] + (place - first) * (above - b["high"])
        if b["n"] == n - skipped and (b["low"], b["high"]) == (low, high):
            break
        skipped, n, low, high = below, below + b["n"], b["low"], b["high"]
        near = values.where(F.col("v").between(low, high))
    if low == high:
        return low
    left = [r["v"] for r in near.orderBy("v").collect()]
    at = first - skipped
    return left[at] + (place - first) * (left[min(at + 1, len(left) - 1)] - left[at])


def fitted(df: DataFrame, labels: DataFrame, text: str, doc_id: str, label: str, pairs: int, group: int = GROUP) -> Ranking:
    """The ranking learned from all rows of ``df`` that have a label."""
    spark, ranking = df.sparkSession, Ranking()
    rows = cut(training_rows(df, labels, text, doc_id, label))
    each = [F.col("measures")[i] for i in range(MEASURES)]
    n, n_good, *moments = rows.agg(F.count("*"), F.count_if("good"), *map(F.avg, each), *map(F.stddev_pop, each)).first()
    if not 0 < n_good < n:
        return ranking
    ranking.middle, ranking.spread = np.array(moments[:MEASURES]), np.array(moments[MEASURES:]) + 1e-9
    rarer = 2 * n_good <= n
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("doc"), F.lit(max(1, n // group))))
    by_doc = F.sort_array(F.collect_list(F.struct("doc", "measures", "good")))
    grouped = cut(dealt.groupBy("part").agg(by_doc.alias("rows")).select(
        "part", F.transform("rows", lambda r: r["measures"]).alias("measures"), F.transform("rows", lambda r: r["good"]).alias("good")))

    def added(shared):
        def run(batches):
            model, total = shared(), np.zeros(1 + 2 * MEASURES + 4 * MEASURES**2)
            for batch in pieces(batches, 16):
                for part, found, good in zip(*(c.to_pylist() for c in batch.columns)):
                    total += model.sums(model.gaps(np.array(found), np.array(good, bool), rarer, pairs, part))
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["total"])

        return grouped.mapInArrow(run, "total array<double>").collect()

    for _ in range(STEPS):
        total = np.sum([r["total"] for r in added(share(spark, ranking))], axis=0)
        if not total[0] or ranking.step(total) < 1e-6:
            break
    shared = share(spark, ranking)

    def strengths(batches):
        model = shared()
        for batch in batches:
            found = model.strengths(np.array(batch.column(0).to_pylist()).reshape(-1, MEASURES))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.float64())], ["v"])

    ranking.cut = quantile(cut(rows.select("measures").mapInArrow(strengths, "v double")), (n - n_good) / n)
    return ranking


def ranked(
    df: DataFrame, training: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality",
    score: str = "score", pairs: int = PAIRS,
) -> DataFrame:
    """The table with each text's score; learned from the rows of ``training`` that ``labels`` (id, label) has."""
    shared = share(df.sparkSession, fitted(training, labels, text, doc_id, label, pairs))
    kept = df.drop(score)

    def run(batches):
        ranking = shared()
        for batch in pieces(batches):
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            found = ranking.scores(np.array([measures(t) for t in texts]).reshape(-1, MEASURES))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*batch.schema.names, score])

    return kept.mapInArrow(run, schema_with(kept, f"`{score}` double"))


def op5_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(F.col("doc_id"), 4))
    out = ranked(docs, docs, labels)
    return out.select("doc_id", held_out(F.col("doc_id"), 4).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
