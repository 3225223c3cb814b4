"""Benchmark items inside documents: size-partitioned min-hash containment search, verified exactly.

Texts are words in lower case, ended by ASCII characters other than letters and digits; characters of scripts that are written
without blanks are words of their own. Shingles are runs of ``K`` words; an item of fewer words is one shingle, all its words,
and is found where a document holds that run. Items are partitioned by size,
powers of two of their number of shingles (one that repeats shingles counts with and without the repeats). For each partition a document is cut into windows of two blocks, a block being
as long as the partition's longest item, so that any item lies whole in some window: inside a window, a containment of
``CONTAINED`` is a Jaccard similarity of at least 0.19, however long the document. Window and item are candidates if any
of ``HASHES`` min-hash values agree; a pair at that bound is missed with a probability of 1e-6. Block minima of a larger
partition are minima of those of the smaller one, so each shingle is hashed once. Candidates are verified by the share of
the item's distinct shingles that the whole document holds, as words, not as hashes.

Items are the query set: they are taken in blocks of at most ``BLOCK_BYTES`` of text, each broadcast by itself; documents
stay where they are, without a shuffle.

Defined cases: null texts hold no item; items with a null text, or under ``K`` words with under ``LEAST_CHARS`` characters in them, are
too short to tell and are found nowhere; items of equal id are separate rows of the answer; repeated documents get equal
answers; other columns pass through.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revsieve.llm.common import columns, documents, fresh, pieces, schema_with, share, ship
from revsieve.llm.words import WordHashes, joined, stirred

ship(__name__)

K = 5
HASHES = 64
CONTAINED = 0.8
BLOCK_BYTES = 8_000_000
STRIP = 4096
LEAST_CHARS = 12  # of an item of fewer than K words
#: Scripts without blanks: Thai and Lao, Burmese, Khmer, East Asian letters and signs with their punctuation.
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x9FFF), (0xF900, 0xFAFF), (0xFF00, 0xFFEF), (0x20000, 0x3FFFF))
EACH = re.compile("([" + "".join(f"{chr(a)}-{chr(b)}" for a, b in UNSPACED) + "])")
BLANKS = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    text = (text or "").lower()
    if not text.isascii():
        text = EACH.sub(r" \1 ", text)
    return text.encode().translate(BLANKS).split()


def runs(words: list[bytes], k: int) -> set[tuple[bytes, ...]]:
    return set(zip(*(words[i:] for i in range(k))))


class Items:
    """Index of one block of items."""

    def __init__(self, rows: list[tuple[int, str]], k: int, hashes: int, least_chars: int):
        self.k = k
        self.short: dict[int, dict[tuple[bytes, ...], list[int]]] = {}
        self.factors = np.array(
            [int.from_bytes(hashlib.blake2b(b"%d" % i, digest_size=8).digest(), "little") | 1 for i in range(hashes)], np.uint64)
        known = WordHashes()
        self.ids, self.shingles = [], []
        by_size: dict[int, list[tuple[int, np.ndarray]]] = defaultdict(list)
        for item_id, text in rows:
            words = words_of(text)
            if len(words) < k:
                if words and len(b"".join(words).decode()) >= least_chars:
                    self.short.setdefault(len(words), {}).setdefault(tuple(words), []).append(len(self.ids))
                    self.ids.append(item_id)
                    self.shingles.append({tuple(words)})
                continue
            shingles = runs(words, k)
            grams = stirred(np.unique(joined(known.high_of(words), k)))
            own = self.minima(grams[:, None])[:, 0]
            for size in {len(shingles).bit_length(), (len(words) - k + 1).bit_length()}:  # two where shingles repeat
                by_size[size].append((len(self.ids), own))
            self.ids.append(item_id)
            self.shingles.append(shingles)
        self.short_hashes = {
            n: np.unique(np.concatenate([joined(known.high_of(list(run)), n) for run in held])) for n, held in self.short.items()}
        self.tables = {}
        for size, members in by_size.items():
            values = np.concatenate([self.salted(m[:, None])[:, 0] for _, m in members])
            owners = np.repeat([i for i, _ in members], hashes)
            order = np.argsort(values, kind="stable")
            seen = np.zeros(1 << 16, bool)
            seen[values & np.uint64(0xFFFF)] = True
            self.tables[size] = values[order], owners[order], seen

    def minima(self, blocks: np.ndarray) -> np.ndarray:
        """Min-hash values of each column of shingle hashes: one row a hash function."""
        return np.stack([(blocks * f).min(axis=0) for f in self.factors])

    def salted(self, minima: np.ndarray) -> np.ndarray:
        """The values with the number of their hash function mixed in."""
        return stirred(minima + np.arange(len(minima), dtype=np.uint64)[:, None])

    def candidates(self, grams: list[np.ndarray]) -> set[tuple[int, int]]:
        """(place of document, item) that may match, from the documents' shingle hashes in text order."""
        if not self.tables or not any(map(len, grams)):
            return set()
        smallest, largest = min(self.tables), max(self.tables)
        block, unit = 1 << smallest, 2 << largest
        counts = [math.ceil(len(g) / unit) * (unit // block) for g in grams]
        padded = [np.concatenate([g, np.full(n * block - len(g), g[-1])]) for g, n in zip(grams, counts) if n]
        shaped = np.concatenate(padded).reshape(-1, block)
        minima = np.concatenate(
            [self.minima(np.ascontiguousarray(shaped[i : i + STRIP].T)) for i in range(0, len(shaped), STRIP)], axis=1)
        owner = np.repeat(np.arange(len(grams)), counts)
        found: set[tuple[int, int]] = set()
        for size in range(smallest, largest + 1):
            if size in self.tables:
                values, items, seen = self.tables[size]
                after = np.append(np.arange(1, len(owner)), len(owner) - 1)
                after = np.where(owner[after] == owner, after, np.arange(len(owner)))
                windows = self.salted(np.minimum(minima, minima[:, after]))
                at = np.nonzero(seen[windows & np.uint64(0xFFFF)])
                hit = windows[at]
                low, high = np.searchsorted(values, hit, "left"), np.searchsorted(values, hit, "right")
                real = np.flatnonzero(high > low)
                for doc, a, b in zip(owner[at[1][real]].tolist(), low[real].tolist(), high[real].tolist()):
                    found.update((doc, i) for i in items[a:b].tolist())
            minima, owner = np.minimum(minima[:, ::2], minima[:, 1::2]), owner[::2]
        return found

    def held_whole(self, hashes: np.ndarray, words: list[bytes]) -> list[int]:
        """The short items that stand in a text."""
        found: set[int] = set()
        for n, wanted in self.short_hashes.items():
            own = joined(hashes, n)
            at = np.minimum(np.searchsorted(wanted, own), len(wanted) - 1)
            for i in np.flatnonzero(wanted[at] == own).tolist():
                found.update(self.short[n].get(tuple(words[i : i + n]), ()))
        return sorted(found)

    def leaks(self, known: WordHashes, texts: list[str | None], contained: float) -> list[list[dict]]:
        """For each text, the items that it holds."""
        words = [words_of(t) for t in texts]
        hashes = [known.high_of(w) for w in words]
        found = self.candidates([stirred(joined(h, self.k)) for h in hashes])
        answers: list[list[dict]] = [
            [{"item_id": self.ids[i], "shingles": 1, "found": 1} for i in self.held_whole(h, w)] for h, w in zip(hashes, words)]
        held: dict[int, set] = {}
        for doc, i in sorted(found):
            if doc not in held:
                held = {doc: runs(words[doc], self.k)}
            n, m = len(self.shingles[i]), len(self.shingles[i] & held[doc])
            if m >= contained * n:
                answers[doc].append({"item_id": self.ids[i], "shingles": n, "found": m})
        return answers


def with_leaks(
    df: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", leaks: str = "leaks",
    k: int = K, hashes: int = HASHES, contained: float = CONTAINED, block_bytes: int = BLOCK_BYTES, least_chars: int = LEAST_CHARS,
) -> DataFrame:
    """The table with a list of (item_id, shingles of the item, shingles found) for the items each document holds."""
    spark = df.sparkSession
    items = items.select(F.col(f"`{item_id}`").cast("bigint").alias("id"), F.col(f"`{item_text}`").alias("text")).where("text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = math.ceil(total / block_bytes)
    out = df.drop(leaks)
    kind = "array<struct<item_id: bigint, shingles: bigint, found: bigint>>"
    (added,) = fresh(out, leaks + "_of_block")
    out = out.withColumn(leaks, F.array().cast(kind))
    entry = pa.list_(pa.struct([("item_id", pa.int64()), ("shingles", pa.int64()), ("found", pa.int64())]))
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block).orderBy("id", "text").collect()
        index = share(spark, Items([(r[0], r[1]) for r in rows], k, hashes, least_chars))

        def run(batches, index=index):
            known, own = WordHashes(), index()
            for batch in pieces(batches):
                texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
                found = pa.array(own.leaks(known, texts, contained), entry)
                yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, added])

        out = out.mapInArrow(run, schema_with(out, f"`{added}` {kind}"))
        out = out.withColumn(leaks, F.concat(leaks, added)).drop(added)
    return out


def without_leaks(df: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents that hold no benchmark item; all columns of the input."""
    (leaks,) = fresh(df, "_leaks")
    return with_leaks(df, items, leaks=leaks, **options).where(F.size(leaks) == 0).select(*columns(df))


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def op6_containment_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return with_leaks(docs, benchmark(spark, sf_dir)).select("doc_id", F.explode("leaks").alias("l")).select(
        "doc_id", "l.item_id", F.col("l.shingles").alias("n_shingles"), F.col("l.found").alias("n_found"))


_EACH = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in UNSPACED)
_WORD = f"[{_EACH}]|[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F{_EACH}]+"


def _words(table: str, key: str) -> str:
    return f"SELECT {key}, regexp_extract_all(lower(text), '{_WORD}') AS w FROM {table}"


def _shingles(words: str, key: str) -> str:
    return f"SELECT DISTINCT {key}, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT {key}, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM {words})"


OP6_SQL = f"""WITH iw AS (SELECT item_id, w, least(len(w), {K}) AS n FROM ({_words('benchmark', 'item_id')})
    WHERE len(w) >= {K} OR len(w) > 0 AND length(array_to_string(w, '')) >= {LEAST_CHARS}),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, w, n FROM ({_words('documents', 'doc_id')}), sizes WHERE len(w) >= n),
i AS ({_shingles('iw', 'item_id')}), d AS ({_shingles('dw', 'doc_id')}),
n AS (SELECT item_id, count(*) AS n_shingles FROM i GROUP BY 1),
f AS (SELECT doc_id, item_id, count(*) AS n_found FROM i JOIN d USING (s) GROUP BY 1, 2)
SELECT doc_id, item_id, n_shingles, n_found FROM f JOIN n USING (item_id) WHERE n_found >= {CONTAINED} * n_shingles"""
