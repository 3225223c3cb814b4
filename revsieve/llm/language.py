"""Language identification by unigram models of pieces, summed over all segmentations.

Pieces are those of a fixed public vocabulary. For each language, piece probabilities are learned by expectation
maximisation from the words of labelled documents: a word's segmentations into pieces are weighed by their probability,
and each piece is counted by the weight of the segmentations that use it. A text's score in a language is the sum over its words
of the log of the sum over all segmentations of the product of piece probabilities, by a forward pass over the letters.
The answer is the language of the highest score; its probability among the languages is given as ``score``.

The model is fitted on a bounded sample of labelled rows, ``SAMPLE`` documents of each language, the first by a hash of the id;
its size is that of the vocabulary times the languages. Words of the sample are counted and weighed on the executors. Scoring
covers whole texts and needs no shuffle; each task keeps a bounded table of words.

Defined cases: texts without letters (null, empty) get ``und`` and score 0; characters outside the vocabulary count alike
in all languages; ties go to the first language by name; without labelled rows every answer is ``und``; repeated rows get equal
answers; other columns pass through.
"""

from __future__ import annotations

import math
from collections import deque

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revsieve.llm.common import documents, held_out, pieces, schema_with, ship

ship(__name__)

SAMPLE = 400
ROUNDS = 3
KEPT = 300_000
LONG = 200  # bytes of a word that is not remembered
SHORT = 40  # letters whose sums stay far from the least double
STEP = 12  # letters between two rescalings
RARE = 1e-7  # probability of a character that is no piece
EDGE = "▁"  # marks the start of a word in the vocabulary
BLANKS = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words in lower case, ended by ASCII characters other than letters."""
    return (text or "").lower().encode().translate(BLANKS).split()


def vocabulary(path: str) -> list[str]:
    """Pieces of letters in a vocabulary file, in lower case."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    return sorted(p for p in found if p.strip(EDGE).isalpha() or p == EDGE)


class Segmenter:
    """Finds the pieces in words and sums over segmentations for several languages at once."""

    def __init__(self, names: list[str], chances: np.ndarray):
        """``chances`` has a row for each piece and a column for each language."""
        self.automaton = ahocorasick.Automaton()
        for name, row in zip(names, chances.tolist()):
            self.automaton.add_word(name, (len(name), name, row))
        self.automaton.make_automaton()
        self.languages = chances.shape[1]
        self.letters = {n for n in names if len(n) == 1}
        self.longest = max(map(len, names), default=1)

    def total(self, word: str) -> list[float]:
        """Sums of the segmentations of a whole word."""
        if not self.letters.issuperset(word):
            return self.forward(word)[0][-1]
        sums: list = [[1.0] * self.languages] + [None] * len(word)
        for end, (size, _, row) in self.automaton.iter(word):
            before, here = sums[end + 1 - size], sums[end + 1]
            if here is None:
                sums[end + 1] = [s * p for s, p in zip(before, row)]
            else:
                sums[end + 1] = [t + s * p for t, s, p in zip(here, before, row)]
        return sums[-1]

    def forward(self, word: str) -> tuple[list[list[float]], list[tuple[int, int, str | None, list[float]]]]:
        """Sums of the segmentations of each prefix, and the arcs (from, to, piece, probabilities)."""
        one, rare = [1.0] * self.languages, [RARE] * self.languages
        sums, arcs, at = [one], [], 0
        by_end: list[list] = [[] for _ in range(len(word) + 1)]
        for end, (size, name, row) in self.automaton.iter(word):
            by_end[end + 1].append((size, name, row))
        for end in range(1, len(word) + 1):
            found = by_end[end]
            if not any(size == 1 for size, _, _ in found):
                found.append((1, None, rare))
            total = [0.0] * self.languages
            for size, name, row in found:
                at = end - size
                total = [t + s * p for t, s, p in zip(total, sums[at], row)]
                arcs.append((at, end, name, row))
            sums.append(total)
        return sums, arcs

    def arcs_by_end(self, word: str, low: int, high: int) -> list[list[tuple[int, str | None, list[float]]]]:
        """For each end in (low, high], the pieces that end there: (letters, piece, probabilities)."""
        start, rare = max(0, low - self.longest), [RARE] * self.languages
        ends: list[list] = [[] for _ in range(high - low)]
        for end, (size, name, row) in self.automaton.iter(word[start:high]):
            if start + end >= low:
                ends[start + end - low].append((size, name, row))
        for found in ends:
            if not any(size == 1 for size, _, _ in found):
                found.append((1, None, rare))
        return ends

    def log_sum(self, word: str) -> list[float]:
        """log of the sum over all segmentations for each language; in long words the sums are rescaled on the way."""
        text = EDGE + word
        if len(text) <= SHORT:
            return [math.log(x) for x in self.total(text)]
        logs, recent = [0.0] * self.languages, deque([[1.0] * self.languages], self.longest)
        for low in range(0, len(text), STEP):
            for found in self.arcs_by_end(text, low, min(low + STEP, len(text))):
                total = [0.0] * self.languages
                for size, _, row in found:
                    total = [t + s * p for t, s, p in zip(total, recent[-size], row)]
                recent.append(total)
            scale = [max(sums) for sums in zip(*recent)]
            logs = [x + math.log(s) for x, s in zip(logs, scale)]
            recent = deque(([x / s for x, s in zip(sums, scale)] for sums in recent), self.longest)
        return [x + math.log(s) for x, s in zip(logs, recent[-1])]

    def expected(self, word: str, language: int) -> list[tuple[str, float]]:
        """Expected number of uses of each piece in a word of one language."""
        text = EDGE + word
        if len(text) > SHORT:
            return self.expected_in_long(text, language)
        sums, arcs = self.forward(text)
        back = [0.0] * len(sums)
        back[-1] = 1.0
        for at, end, _, row in reversed(arcs):
            back[at] += row[language] * back[end]
        whole = sums[-1][language]
        return [(name, sums[at][language] * row[language] * back[end] / whole) for at, end, name, row in arcs if name]

    def expected_in_long(self, text: str, language: int) -> list[tuple[str, float]]:
        """The same by logarithms, with the pieces of one stretch of the word at a time in memory."""
        n, stretch = len(text), 4096
        sums, back, uses = np.zeros(n + 1), np.full(n + 1, -np.inf), {}
        for low in range(0, n, stretch):
            for end, found in enumerate(self.arcs_by_end(text, low, min(low + stretch, n)), low + 1):
                logs = [sums[end - size] + math.log(row[language]) for size, _, row in found]
                top = max(logs)
                sums[end] = top + math.log(sum(math.exp(x - top) for x in logs))
        back[n] = 0.0
        for low in range((n - 1) // stretch * stretch, -1, -stretch):
            ends = self.arcs_by_end(text, low, min(low + stretch, n))
            for end in range(low + len(ends), low, -1):
                for size, name, row in ends[end - low - 1]:
                    path = math.log(row[language]) + back[end]
                    back[end - size] = np.logaddexp(back[end - size], path)
                    if name:
                        uses[name] = uses.get(name, 0.0) + math.exp(sums[end - size] + path - sums[n])
        return list(uses.items())


def sampled_words(df: DataFrame, text: str, label: str, order: Column, sample: int) -> DataFrame:
    """(lang, word, n) of the sample; its documents are chosen from narrow rows."""
    rows = df.select(F.col(f"`{label}`").alias("lang"), order.alias("key"), F.xxhash64(F.col(f"`{text}`")).alias("part")).where("lang IS NOT NULL")
    window = Window.partitionBy("lang").orderBy(F.xxhash64("key"), "key", "part")
    chosen = rows.withColumn("number", F.row_number().over(window)).where(F.col("number") <= sample).select("lang", "key", "part").distinct()
    texts = df.select(F.col(f"`{label}`").alias("lang"), order.alias("key"), F.col(f"`{text}`").alias("text")).withColumn("part", F.xxhash64("text"))

    def run(batches):
        for batch in pieces(batches):
            langs, found = [], []
            for lang, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = [w.decode("utf-8", "replace") for w in words_of(value)]
                langs += [lang] * len(words)
                found += words
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(found, pa.string())], ["lang", "word"])

    kept = texts.join(F.broadcast(chosen), ["lang", "key", "part"]).select("lang", "text")
    return kept.mapInArrow(run, "lang string, word string").groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))


def fitted(words: DataFrame, names: list[str], rounds: int) -> tuple[list[str], np.ndarray]:
    """Languages and, for each piece and language, its probability."""
    sc = words.sparkSession.sparkContext
    words = words.repartition(sc.defaultParallelism, "lang", "word").cache()
    languages = [r[0] for r in words.select("lang").distinct().orderBy("lang").collect()]
    place = {name: i for i, name in enumerate(names)}
    chances = np.full((len(names), max(len(languages), 1)), 1.0 / max(len(names), 1))
    for _ in range(rounds if languages else 0):
        shared = sc.broadcast(chances)

        def run(batches, shared=shared):
            segmenter, counts = Segmenter(names, shared.value), {}
            for batch in batches:
                for lang, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                    for name, uses in segmenter.expected(word, languages.index(lang)):
                        counts[lang, name] = counts.get((lang, name), 0.0) + uses * n
            if counts:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[0] for k in counts]), pa.array([k[1] for k in counts]), pa.array(list(counts.values()))], ["lang", "piece", "uses"])

        found = words.mapInArrow(run, "lang string, piece string, uses double").groupBy("lang", "piece").agg(F.sum("uses").alias("uses"))
        new = np.full(chances.shape, 0.05)
        for lang, piece, uses in found.toPandas().itertuples(index=False):  # at most pieces times languages
            new[place[piece], languages.index(lang)] += uses
        chances = new / new.sum(axis=0)
    words.unpersist()
    return languages, chances


def identified(
    df: DataFrame, training: DataFrame, path: str, text: str = "text", label: str = "lang", doc_id: str = "doc_id",
    answer: str = "lang_pred", score: str = "score", sample: int = SAMPLE, rounds: int = ROUNDS,
) -> DataFrame:
    """The table with each text's language and its probability; learned from ``training`` (same columns)."""
    names = vocabulary(path)
    languages, chances = fitted(sampled_words(training, text, label, F.col(f"`{doc_id}`"), sample), names, rounds)
    shared = df.sparkSession.sparkContext.broadcast((names, chances))
    kept = df.drop(answer, score)

    def run(batches):
        segmenter = Segmenter(*shared.value)
        known: dict[bytes, list[float]] = {}
        for batch in pieces(batches):
            answers, scores = [], []
            for value in batch.column(batch.schema.get_field_index(text)).to_pylist():
                if not languages or not any(map(str.isalpha, value or "")):
                    answers.append("und")
                    scores.append(0.0)
                    continue
                words = words_of(value)
                if len(known) > KEPT:
                    known.clear()
                own = {}
                for w in set(words).difference(known):
                    (known if len(w) <= LONG else own)[w] = segmenter.log_sum(w.decode("utf-8", "replace"))
                total = np.array([known[w] if w in known else own[w] for w in words]).sum(axis=0) if words else np.zeros(len(languages))
                best = int(total.argmax())
                answers.append(languages[best])
                scores.append(float(1.0 / np.exp(total - total[best]).sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(answers, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, answer, score])

    return kept.mapInArrow(run, schema_with(kept, f"`{answer}` string", f"`{score}` double"))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op9_marginal_unigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    training = docs.where(~held_out(F.col("doc_id"), 4))
    out = identified(docs.select("doc_id", "text"), training, default_path())
    return out.select("doc_id", held_out(F.col("doc_id"), 4).alias("held_out"), "lang_pred", "score")
