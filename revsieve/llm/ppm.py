"""Prediction by partial matching over bytes: code length of documents under a pretrained context trie.

A text is its words in lower case (A-Z), a blank after each, and an end mark. The trie holds, for contexts of 0 to ``ORDER``
bytes, how often each byte followed in the training documents. The probability of a byte comes from the longest
context that has it; each longer one costs its escape probability, estimated from the number of distinct bytes seen there, and
excludes the bytes it has seen from the shorter ones: each byte seen gives up half a count. A byte that no context has is uniform over those left.

The trie has every context of the training documents. Contexts of fewer than ``NEAR`` bytes are sent to the executors; the longer
ones lie in blocks by their last ``NEAR`` bytes, so that a block has all that the probability of its bytes takes. The blocks first give
the probabilities of grams of order + 1 bytes that at least one in ``NODES`` of all training bytes ended, at most ``NODES``: these
are known to each task. The other grams of a document go to their block, packed, and what they add up to comes back.

Beside it, each document gets its words' add-one unigram score. Word counts are gathered by blocks of hashed words; the
``COMMON`` most frequent words are then known to each task, and only the others of a document go through a second
shuffle to their block, packed, where they meet the counts; what they add up to goes back to the documents, packed as well.

Defined cases: null and empty texts have the end mark as only token; a null id is a training document; repeated rows get equal
scores, one row each; without training documents all words are unknown and all bytes uniform; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revsieve.llm.common import documents, held_out, pieces, share, ship
from revsieve.llm.words import WordHashes, stirred
from revsieve.plans.lineage import new_dir

ship(__name__)

ORDER = 5
NODES = 1 << 21
NEAR = 3
COMMON = 50_000
BLOCK_BYTES = 100_000_000
HELD_BYTES = 4_000_000
NO_ID = -(2**63)
START, END = b"\xfe", b"\xff"  # bytes that no UTF-8 text has


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    folder = new_dir(spark, name)
    df.write.parquet(folder)
    return spark.read.parquet(folder)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def grams(texts: list[list[bytes]], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Each byte with the ``order`` bytes before it, as one number, older bytes higher; and the number of bytes of each text."""
    streams = [START * order + b"".join([w + b" " for w in words]) + END for words in texts]
    data = np.frombuffer(b"".join(streams), np.uint8).astype(np.uint64)
    n = len(data) - order
    out = np.zeros(n, np.uint64)
    for j in range(order + 1):
        out <<= np.uint64(8)
        out |= data[j : j + n]
    lengths = np.array([len(s) for s in streams])
    ends = np.cumsum(lengths)
    inside = np.ones(n, bool)
    for e in ends[:-1].tolist():  # contexts that would reach into the text before
        inside[e - order : e] = False
    return out[inside], lengths - order


# -- counting -------------------------------------------------------------------------


def counted(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    first = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.empty(0, np.int64)
    return values[first], np.add.reduceat(counts, first) if len(first) else counts


def context_counts(rows: DataFrame, order: int) -> DataFrame:
    """(size, gram, n) for grams of 1 to order + 1 bytes of the training texts."""
    def run(batches):
        values, counts, held = np.empty(0, np.uint64), np.empty(0, np.int64), 0

        def rows_of(values, counts):
            for size in range(order + 1, 0, -1):
                values, counts = counted(values & np.uint64((1 << (8 * size)) - 1), counts)
                for low in range(0, len(values), 100_000):
                    part = slice(low, low + 100_000)
                    n = len(values[part])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, size, np.int32)), pa.array(values[part].view(np.int64)), pa.array(counts[part])], ["size", "gram", "n"])

        for batch in pieces(batches):
            texts = [words_of(t) for t in batch.column(0).to_pylist()]
            if texts:
                new = np.unique(grams(texts, order)[0], return_counts=True)
                values, counts = counted(np.concatenate([values, new[0]]), np.concatenate([counts, new[1]]))
                if len(values) > HELD_BYTES:
                    yield from rows_of(values, counts)
                    values, counts = values[:0], counts[:0]
        if len(values):
            yield from rows_of(values, counts)

    found = rows.select("text").mapInArrow(run, "size int, gram bigint, n bigint")
    return found.groupBy("size", "gram").agg(F.sum("n").alias("n"))


class Trie:
    """Contexts as sorted arrays for each order."""

    def __init__(self, order: int, rows: list[tuple[int, np.ndarray, np.ndarray]]):
        """``rows`` has (size, grams, counts) by size of gram."""
        self.order, self.levels = order, []
        total = 0
        for k in range(order + 1):
            found, n = next(((g, c) for size, g, c in rows if size == k + 1), (np.empty(0, np.uint64), np.empty(0, np.int64)))
            at = np.argsort(found)
            found, n = found[at], n[at].astype(float)
            if k == 0:
                total = n.sum()
            level = {"grams": found, "n": n}
            level["contexts"], first = np.unique(found >> np.uint64(8), return_index=True)
            level["kept"] = np.add.reduceat(n, first) if len(first) else n
            level["kinds"] = np.diff(np.append(first, len(found))).astype(float)
            if k:
                shorter = self.levels[-1]
                passed, known = self._find(shorter["grams"], shorter["n"], level["contexts"])
                level["passed"] = np.maximum(np.where(known, passed, level["kept"]), level["kept"])
                below, _ = self._find(shorter["grams"], shorter["n"], found & np.uint64((1 << (8 * k)) - 1))
                level["below"] = np.add.reduceat(below, first) if len(first) else below
            else:
                level["passed"] = np.full(len(level["contexts"]), total)
                level["below"] = np.zeros(len(level["contexts"]))
            self.levels.append(level)

    @staticmethod
    def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(wanted)), np.zeros(len(wanted), bool)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        known = keys[at] == wanted
        return np.where(known, values[at], 0.0), known

    def log10(self, wanted: np.ndarray) -> np.ndarray:
        """log10 of the probability of each gram's last byte after the others."""
        out = np.zeros(len(wanted))
        open_ = np.arange(len(wanted))
        left_out = np.zeros(len(wanted))  # mass and number of bytes excluded at this order
        kinds_out = np.zeros(len(wanted))
        for k in range(self.order, -1, -1):
            level = self.levels[k]
            gram = wanted[open_] & np.uint64((1 << (8 * (k + 1))) - 1)
            context = gram >> np.uint64(8)
            n, seen = self._find(level["grams"], level["n"], gram)
            kept, known = self._find(level["contexts"], level["kept"], context)
            passed = self._find(level["contexts"], level["passed"], context)[0]
            kinds = self._find(level["contexts"], level["kinds"], context)[0]
            below = self._find(level["contexts"], level["below"], context)[0]
            whole = passed - left_out[open_]
            escape = whole - (kept - left_out[open_]) + (kinds - kinds_out[open_]) / 2
            use = known & (whole > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                out[open_] += np.where(use, np.log10(np.where(seen, n - 0.5, np.maximum(escape, 1e-300)) / whole), 0.0)
            left_out[open_] = np.where(known, below, left_out[open_])
            kinds_out[open_] = np.where(known, kinds, kinds_out[open_])
            open_ = open_[~seen]
        out[open_] -= np.log10(np.maximum(256 - kinds_out[open_], 1.0))
        return out


# -- contexts in blocks -----------------------------------------------------------------

TABLE = [("gram", np.uint64), ("n", np.int64), ("size", np.int8)]
WANTED = [("gram", np.uint64), ("n", np.int64), ("doc", np.int64), ("part", np.int64)]


def blobs_of(entries: dict[str, np.ndarray], form: list, blocks: int):
    """(block, packed entries), the block being that of the last ``NEAR`` bytes of each gram's context."""
    context = (entries["gram"] >> np.uint64(8)) & np.uint64((1 << (8 * NEAR)) - 1)
    block = (stirred(context) % np.uint64(blocks)).astype(np.int64)
    order, pack = np.argsort(block, kind="stable"), zstandard.ZstdCompressor(level=1)
    edges = np.flatnonzero(np.diff(block[order], prepend=-1, append=-1))
    for low, high in zip(edges[:-1].tolist(), edges[1:].tolist()):
        yield int(block[order[low]]), pack.compress(b"".join(entries[k][order[low:high]].astype(t).tobytes() for k, t in form))


def entries_of(blob: bytes, form: list) -> dict[str, np.ndarray]:
    data, out, start = zstandard.ZstdDecompressor().decompress(blob), {}, 0
    n = len(data) // sum(np.dtype(t).itemsize for _, t in form)
    for k, t in form:
        out[k] = np.frombuffer(data, t, n, start)
        start += n * np.dtype(t).itemsize
    return out


def context_tables(contexts: DataFrame, blocks: int) -> DataFrame:
    """(block, data) from (size, gram, n): grams with contexts of at least ``NEAR`` bytes, packed by block."""
    def run(batches):
        held, size = [], 0

        def flush():
            entries = {k: np.concatenate([e[k] for e in held]) for k in held[0]}
            held.clear()
            found = list(blobs_of(entries, TABLE, blocks))
            return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.binary())], ["block", "data"])

        for batch in batches:
            kind, gram, n = (c.to_numpy() for c in batch.columns)
            held.append({"gram": gram.view(np.uint64), "n": n, "size": kind})
            size += len(gram)
            if size > HELD_BYTES:
                yield flush()
                size = 0
        if size:
            yield flush()

    return contexts.where(F.col("size") > NEAR).select("size", "gram", "n").mapInArrow(run, "block int, data binary")


def block_trie(order: int, small: list, blobs: list[bytes]) -> Trie:
    """The trie as far as one block needs it: all short contexts and the block's own."""
    found = [entries_of(b, TABLE) for b in blobs]
    every = {k: np.concatenate([e[k] for e in found]) if found else np.empty(0, t) for k, t in TABLE}
    return Trie(order, small + [(k, every["gram"][every["size"] == k], every["n"][every["size"] == k]) for k in range(NEAR + 1, order + 2)])


def frequent_scores(tables: DataFrame, short, order: int, least: int, blocks: int):
    """Grams of order + 1 bytes that occur ``least`` times or more, sorted, and their log10 probabilities."""
    def run(batches):
        small = short()
        for blobs in by_block(batches).values():
            trie = block_trie(order, small, blobs)
            top = trie.levels[order]["grams"][trie.levels[order]["n"] >= least]
            yield pa.RecordBatch.from_arrays([pa.array(top.view(np.int64)), pa.array(trie.log10(top))], ["gram", "score"])

    found = tables.repartition(blocks, "block").mapInArrow(run, "gram bigint, score double").toPandas()
    grams_, scores = found["gram"].to_numpy(np.int64).view(np.uint64), found["score"].to_numpy(float)
    at = np.argsort(grams_)
    return grams_[at], scores[at]


def rare_scores(tables: DataFrame, wanted: DataFrame, short, order: int, blocks: int) -> DataFrame:
    """(home, data): packed sums of the log10 probabilities of the grams of ``wanted``, which has packed ones in ``data``."""
    def run(batches):
        small, block, blobs, trie, held = short(), None, [], None, []
        for batch in batches:
            for b, late, data in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (b != block or sum(len(x[0]) for x in held) > 1_000_000):
                    yield homes(*added_up(*map(np.concatenate, zip(*held))), blocks)
                    held = []
                if b != block:
                    block, blobs, trie = b, [], None
                if not late:
                    blobs.append(data)
                    continue
                if trie is None:
                    trie, blobs = block_trie(order, small, blobs), []
                e = entries_of(data, WANTED)
                kind, inverse = np.unique(e["gram"], return_inverse=True)
                held.append(added_up(e["doc"], e["part"], np.zeros(len(inverse), np.int64), trie.log10(kind)[inverse] * e["n"]))
        if held:
            yield homes(*added_up(*map(np.concatenate, zip(*held))), blocks)

    both = tables.withColumn("late", F.lit(0)).unionByName(wanted.withColumn("late", F.lit(1)))
    sorted_ = both.select("block", "late", "data").repartition(blocks, "block").sortWithinPartitions("block", "late")
    return sorted_.mapInArrow(run, "home int, data binary")


# -- words ----------------------------------------------------------------------------

PACK = [("a", np.uint64), ("b", np.uint64), ("n", np.int64), ("doc", np.int64), ("part", np.int64)]


def packed(entries: dict[str, np.ndarray], blocks: int):
    block = (entries["a"] % np.uint64(blocks)).astype(np.int64)
    order = np.argsort(block, kind="stable")
    block, pack = block[order], zstandard.ZstdCompressor(level=1)
    edges = np.flatnonzero(np.diff(block, prepend=-1, append=-1))
    for low, high in zip(edges[:-1].tolist(), edges[1:].tolist()):
        yield int(block[low]), pack.compress(b"".join(entries[k][order[low:high]].astype(t).tobytes() for k, t in PACK))


def unpacked(blobs: list[bytes]) -> dict[str, np.ndarray]:
    unpack, columns = zstandard.ZstdDecompressor(), {k: [] for k, _ in PACK}
    for blob in blobs:
        data = unpack.decompress(blob)
        n = len(data) // 40
        for i, (k, t) in enumerate(PACK):
            columns[k].append(np.frombuffer(data[8 * n * i : 8 * n * (i + 1)], t))
    return {k: np.concatenate(v) if v else np.empty(0, t) for (k, t), v in zip(PACK, columns.values())}


def pairs(a: np.ndarray, b: np.ndarray, n: np.ndarray):
    """Distinct (a, b) with their sums."""
    order = np.lexsort((b, a))
    a, b, n = a[order], b[order], n[order]
    first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.empty(0, np.int64)
    return a[first], b[first], np.add.reduceat(n, first) if len(first) else n


def added_up(doc: np.ndarray, part: np.ndarray, known: np.ndarray, base: np.ndarray):
    """One entry for each document, with the sums of the last two."""
    at = np.lexsort((part, doc))
    doc, part, known, base = doc[at], part[at], known[at], base[at]
    first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (part[1:] != part[:-1])))
    return doc[first], part[first], np.add.reduceat(known, first), np.add.reduceat(base, first)


def homes(doc: np.ndarray, part: np.ndarray, known: np.ndarray, base: np.ndarray, blocks: int) -> pa.RecordBatch:
    """(home, data): sums of documents, packed by the block in which a document's sums meet."""
    home = (stirred(doc.view(np.uint64)) % np.uint64(blocks)).astype(np.int64)
    order = np.argsort(home, kind="stable")
    edges = np.flatnonzero(np.diff(home[order], prepend=-1, append=-1))
    rows = [(int(home[order[low]]), b"".join(x[order[low:high]].tobytes() for x in (doc, part, known, base)))
            for low, high in zip(edges[:-1].tolist(), edges[1:].tolist())]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["home", "data"])


def word_counts(rows: DataFrame, blocks: int) -> DataFrame:
    """(block, a, b, n): training words, hashed to (a, b), with their counts, in their blocks."""
    def send(batches):
        known, counts = WordHashes(), {}

        def flush():
            words = list(counts)
            a, b = known.of(words)
            n = np.fromiter(counts.values(), np.int64, len(words))
            zero = np.zeros(len(words), np.int64)
            found = list(packed({"a": a, "b": b, "n": n, "doc": zero, "part": zero}, blocks))
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.binary())], ["block", "data"])

        for batch in pieces(batches):
            for text in batch.column(0).to_pylist():
                for w in words_of(text):
                    counts[w] = counts.get(w, 0) + 1
            if len(counts) > 300_000:
                yield flush()
        if counts:
            yield flush()

    def add(batches):
        for block, blobs in by_block(batches).items():
            every = unpacked(blobs)
            a, b, n = pairs(every["a"], every["b"], every["n"])
            for low in range(0, len(a), 100_000):
                part = slice(low, low + 100_000)
                size = len(a[part])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(size, block, np.int32)), pa.array(a[part].view(np.int64)), pa.array(b[part].view(np.int64)), pa.array(n[part])],
                    ["block", "a", "b", "n"])

    sent = rows.select("text").mapInArrow(send, "block int, data binary").repartition(blocks, "block")
    return sent.mapInArrow(add, "block int, a bigint, b bigint, n bigint")


def by_block(batches) -> dict[int, list[bytes]]:
    found: dict[int, list[bytes]] = {}
    for batch in batches:
        for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found.setdefault(block, []).append(data)
    return found


SUMS = "doc bigint, part bigint, held_out boolean, copies bigint, n_tokens bigint, n_known bigint, base double, score double"


def scored(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", parts: int = 7, order: int = ORDER, nodes: int = NODES, common: int = COMMON,
) -> DataFrame:
    """One row a document: (doc, held_out, n_tokens, n_known, train_tokens, base_score, score)."""
    spark, t, key = df.sparkSession, F.col(f"`{text}`"), F.col(f"`{doc_id}`")
    rows = df.select(
        F.coalesce(key.cast("bigint"), F.lit(NO_ID)).alias("doc"), F.crc32(F.coalesce(t, F.lit("")).cast("binary")).alias("part"),
        t.alias("text"), held_out(key, parts).alias("held_out"))
    training = rows.where("NOT held_out")
    length = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-length // BLOCK_BYTES))
    contexts = written(spark, context_counts(training, order), "contexts")
    of_size = contexts.where(F.col("size") <= NEAR).toPandas()  # at most 256 ** NEAR
    short = share(spark, [(int(s), g["gram"].to_numpy().view(np.uint64), g["n"].to_numpy()) for s, g in of_size.groupby("size")])
    bytes_in = int(of_size["n"][of_size["size"] == 1].sum())
    tables = written(spark, context_tables(contexts, blocks), "tables")
    scores = spark.sparkContext.broadcast(frequent_scores(tables, short, order, -(-bytes_in // nodes), blocks))
    counts = written(spark, word_counts(training, blocks), "words")
    texts = training.count()
    words, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    total, distinct = words + texts, kinds + (texts > 0)  # the end mark is a token too
    top = counts.orderBy(F.desc("n"), "a", "b").limit(common).select("a", "b", "n").toPandas()
    first = np.argsort(top["a"].to_numpy().view(np.uint64), kind="stable")
    frequent = spark.sparkContext.broadcast(tuple(top[c].to_numpy()[first].view(np.uint64) for c in ("a", "b", "n")))
    end = float(np.log10(texts + 1))
    unit = float(np.log10(total + distinct + 1))

    NAMES = ["block", "data", "doc", "part", "held_out", "n_tokens", "n_known", "base", "score", "grams"]

    def send(batches):
        known, waiting, rare = WordHashes(), [], []
        scored_grams, gram_scores = scores.value
        keys, checks, numbers = frequent.value
        for batch in pieces(batches, 128):
            docs, sums, texts_, held = (batch.column(i).to_pylist() for i in range(4))
            lists = [words_of(x) for x in texts_]
            size = np.array([len(x) for x in lists])
            owner = np.repeat(np.arange(len(lists)), size)
            a, b = known.of([w for x in lists for w in x])
            at = np.minimum(np.searchsorted(keys, a), max(len(keys) - 1, 0))
            here = (keys[at] == a) & (checks[at] == b) if len(keys) else np.zeros(len(a), bool)
            n = numbers[at[here]].astype(float) if len(keys) else np.empty(0)
            base = np.bincount(owner[here], np.log10(n + 1), len(lists)) + end - unit * (size + 1)
            found = np.bincount(owner[here], minlength=len(lists)) + (end > 0)
            wanted, lengths = grams(lists, order)
            kind, inverse = np.unique(wanted, return_inverse=True)
            place = np.minimum(np.searchsorted(scored_grams, kind), max(len(scored_grams) - 1, 0))
            seen = scored_grams[place] == kind if len(scored_grams) else np.zeros(len(kind), bool)
            value = np.zeros(len(kind))
            value[seen] = gram_scores[place[seen]]
            reader = np.repeat(np.arange(len(lists)), lengths)
            score = np.bincount(reader, value[inverse], len(lists))
            missed = ~seen[inverse]
            each, times = np.unique(reader[missed] * len(kind) + inverse[missed], return_counts=True)
            reader, each = each // len(kind), each % len(kind)
            rare.append({"gram": kind[each], "n": times, "doc": np.array(docs, np.int64)[reader], "part": np.array(sums, np.int64)[reader]})
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(lists), -1, np.int32)), pa.nulls(len(lists), pa.binary()), pa.array(docs, pa.int64()), pa.array(sums, pa.int64()),
                pa.array(held), pa.array(size + 1, pa.int64()), pa.array(found, pa.int64()), pa.array(base), pa.array(score),
                pa.nulls(len(lists), pa.binary())], NAMES)
            entry = {"a": a[~here], "b": b[~here], "n": np.zeros((~here).sum(), np.int64),
                     "doc": np.array(docs, np.int64)[owner[~here]], "part": np.array(sums, np.int64)[owner[~here]]}
            waiting.append(entry)
            if sum(len(e["a"]) for e in waiting) > 400_000:
                yield flush(waiting)
            if sum(len(e["gram"]) for e in rare) > 1_000_000:
                yield flush_grams(rare)
        if waiting:
            yield flush(waiting)
        if rare:
            yield flush_grams(rare)

    def flush(waiting):
        entries = {k: np.concatenate([e[k] for e in waiting]) for k in waiting[0]}
        waiting.clear()
        found = list(packed(entries, blocks))
        return row_of([f[0] for f in found], [f[1] for f in found], None)

    def flush_grams(rare):
        entries = {k: np.concatenate([e[k] for e in rare]) for k in rare[0]}
        rare.clear()
        found = list(blobs_of(entries, WANTED, blocks))
        return row_of([f[0] for f in found], None, [f[1] for f in found])

    def row_of(block, data, grams_):
        size = len(block)
        none = [pa.nulls(size, k) for k in (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
        blobs = [pa.nulls(size, pa.binary()) if x is None else pa.array(x, pa.binary()) for x in (data, grams_)]
        return pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), blobs[0], *none, blobs[1]], NAMES)

    sent = written(spark, rows.mapInArrow(
        send, "block int, data binary, doc bigint, part bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, score double, grams binary"), "sent")

    def pack_counts(batches):
        for batch in batches:
            block = batch.column(0).to_numpy()
            a, b, n = (batch.column(i).to_numpy() for i in (1, 2, 3))
            zero = np.zeros(len(a), np.int64)
            found = list(packed({"a": a.view(np.uint64), "b": b.view(np.uint64), "n": n, "doc": zero, "part": zero}, blocks)) if len(block) else []
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.binary())], ["block", "data"])

    def meet(batches):
        for blobs in by_block(batches).values():
            every = unpacked(blobs)
            is_count = every["n"] > 0
            order_ = np.lexsort((~is_count, every["b"], every["a"]))
            every = {k: v[order_] for k, v in every.items()}
            is_count = every["n"] > 0
            new = np.append(True, (every["a"][1:] != every["a"][:-1]) | (every["b"][1:] != every["b"][:-1]))
            head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            value = np.where(is_count[head], every["n"][head], 0)[~is_count]
            doc, part = every["doc"][~is_count], every["part"][~is_count]
            if not len(doc):
                continue
            doc, part, known, base = added_up(doc, part, (value > 0).astype(np.int64), np.log10(value + 1.0))
            yield homes(doc, part, known, base, blocks)

    def add_up(batches):
        blobs = [x for batch in batches for x in batch.column(1).to_pylist()]
        if blobs:
            columns = [[], [], [], []]
            for data in blobs:
                n = len(data) // 32
                for i, kind in enumerate((np.int64, np.int64, np.int64, np.float64)):
                    columns[i].append(np.frombuffer(data[8 * n * i : 8 * n * (i + 1)], kind))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in added_up(*map(np.concatenate, columns))], ["doc", "part", "n_known", "base"])

    dealt = sent.where("block >= 0 AND data IS NOT NULL").select("block", "data").unionByName(counts.mapInArrow(pack_counts, "block int, data binary"))
    met = dealt.repartition(blocks, "block").mapInArrow(meet, "home int, data binary")
    rare = met.repartition(blocks, "home").mapInArrow(add_up, "doc bigint, part bigint, n_known bigint, base double").withColumn("score", F.lit(0.0))
    wanted = sent.where("grams IS NOT NULL").select("block", F.col("grams").alias("data"))
    more = rare_scores(tables, wanted, short, order, blocks).repartition(blocks, "home").mapInArrow(
        add_up, "doc bigint, part bigint, n_known bigint, base double").withColumns({"score": F.col("base"), "base": F.lit(0.0)})
    whole = sent.where("block < 0").select("doc", "part", "held_out", F.lit(1).cast("bigint").alias("copies"), "n_tokens", "n_known", "base", "score")
    nothing = {"held_out": F.lit(None).cast("boolean"), "copies": F.lit(0).cast("bigint"), "n_tokens": F.lit(0).cast("bigint")}
    summed = whole.unionByName(rare.unionByName(more).withColumns(nothing)).groupBy("doc", "part").agg(
        F.max("held_out").alias("held_out"), *(F.sum(c).alias(c) for c in ("copies", "n_tokens", "n_known", "base", "score")))
    each = summed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return each.select(
        F.nullif("doc", F.lit(NO_ID)).alias("doc_id"), "held_out", F.expr("n_tokens div copies").alias("n_tokens"),
        F.expr("n_known div copies").alias("n_known"), F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("base") / F.col("copies")).alias("base_score"), (F.col("score") / F.col("copies")).alias("score"))


def op3_partial_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(documents(spark, sf_dir))
