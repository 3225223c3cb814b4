"""Substring deduplication by relative Lempel-Ziv parsing against all documents with a smaller id.

Every document is parsed into factors: runs of words that some earlier document holds too, and single words. A factor
counts from ``SIZE`` words on. The reference, all documents, is indexed in blocks by hash, and a parse meets the parts
of the index that hold its own pieces.

1. *Pieces.* Any ``SIZE`` words in a row have one anchor: the first of their word runs of length ``GRAM`` by the length, then
   the hash, of its first word. The words of neighbouring windows with one anchor are a piece. Equal windows have equal anchors,
   and a run of words shared by two documents consists of equal pieces, but for its ends.
2. *Index blocks.* Pieces go to the block of their anchor. The first document of each piece is its reference, and the piece
   is a factor in all later documents.
3. *Factor boundaries.* Where an anchor has several pieces, a factor ends inside a piece. The windows of each such piece's first
   document are looked up one by one, in a second index of windows, so no shared window is lost.
4. Each document's factors are put together, and the words that they cover are removed.

A task compares its own documents before it sends anything: of equal pieces (windows), only that of the least id goes into
the shuffle, so a passage in a third of all documents costs one entry a task, and no group is listed anywhere. Entries are
packed by block, 128 bits of hash each. The number of blocks follows the size of the texts. Texts are shuffled by document for
steps 3 and 4, at every size alike.

Defined cases: null, empty and short texts have no windows; a null id comes before all others; documents of equal id are
not references of each other; other columns are left alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revsieve.llm.common import documents, pieces, ship
from revsieve.llm.words import WordHashes, joined, stirred
from revsieve.plans.lineage import new_dir

ship(__name__)

SIZE = 13
GRAM = 3
BLOCK_BYTES = 100_000_000
HELD = 300_000
NO_ID = -(2**63)
PLACE = np.uint64((1 << 28) - 1)
#: One piece or window: two hashes, its document (id and checksum of the text), first window, number of windows, and the
#: document that it refers to, which is its own if none is known.
ENTRY = [("a", np.uint64), ("b", np.uint64), ("doc", np.int64), ("part", np.int64), ("start", np.int32), ("n", np.int32), ("ref", np.int64)]
FOUND = "doc bigint, part bigint, start int, n int, reference bigint, several boolean"


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    folder = new_dir(spark, name)
    df.write.parquet(folder)
    return spark.read.parquet(folder)


def keyed(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Id, a checksum of the text to tell rows of equal id apart, and the text."""
    t = F.col(f"`{text}`")
    return df.select(
        F.coalesce(F.col(f"`{doc_id}`").cast("bigint"), F.lit(NO_ID)).alias("doc"), F.crc32(F.coalesce(t, F.lit("")).cast("binary")).alias("part"),
        t.alias("text"),
    )


# -- pieces of one document -----------------------------------------------------------


def anchors(words: list[bytes], hashes: np.ndarray, size: int) -> np.ndarray:
    """For each window, the place of its anchor."""
    lengths = np.minimum(np.fromiter(map(len, words), np.uint64, len(words)), np.uint64(15))
    places = np.arange(len(words), dtype=np.uint64)
    # long words first, then by hash; the place makes the first one of equal words the least
    least = (((np.uint64(15) - lengths) << np.uint64(60)) | ((hashes >> np.uint64(36)) << np.uint64(32)) & ~PLACE | places)[: len(words) - GRAM + 1]
    span, width = size - GRAM + 1, 1
    while width < span:
        step = min(width, span - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    return (least & PLACE).astype(np.int64)


def pieces_of(words: list[bytes], known: WordHashes, size: int):
    """Anchor hash, piece hash, first window and number of windows of a text's pieces."""
    hashes = known.high_of(words)
    at = anchors(words, hashes, size)
    starts = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
    ends = np.append(starts[1:], len(at))
    anchor = stirred(joined(hashes, GRAM))[at[starts]]
    windows = stirred(joined(hashes, size, 1))
    inside = np.arange(len(windows)) - np.repeat(starts, ends - starts)
    sums = np.add.reduceat(windows * (stirred(inside.astype(np.uint64)) | np.uint64(1)), starts)
    return anchor, stirred(sums + (ends - starts).astype(np.uint64)), starts, ends - starts


def windows_of(words: list[bytes], known: WordHashes, spans: list, size: int):
    """Both hashes and the place of every window in the spans (first window, number of windows)."""
    high, low = known.of(words)
    at = np.unique(np.concatenate([np.arange(s["start"], s["start"] + s["n"]) for s in spans]))
    return stirred(joined(high, size))[at], stirred(joined(low, size, 1))[at], at, np.ones(len(at), np.int32)


# -- index blocks ---------------------------------------------------------------------


def ranked(entries: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Entries in the order of hashes and documents, and for each the place of the first one of equal hashes."""
    order = np.lexsort((entries["doc"], entries["b"], entries["a"]))
    entries = {k: v[order] for k, v in entries.items()}
    new = np.ones(len(order), bool)
    new[1:] = (entries["a"][1:] != entries["a"][:-1]) | (entries["b"][1:] != entries["b"][:-1])
    return entries, np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))


def packed(entries: dict[str, np.ndarray], blocks: int):
    """Rows (block, bytes) of a task's entries, after those that an earlier document of the task holds are marked."""
    entries, first = ranked(entries)
    entries["ref"] = entries["doc"][first]
    block = (entries["a"] % np.uint64(blocks)).astype(np.int64)
    order = np.argsort(block, kind="stable")
    block, entries = block[order], {k: v[order] for k, v in entries.items()}
    edges = np.flatnonzero(np.diff(block, prepend=-1, append=-1))
    pack = zstandard.ZstdCompressor(level=1)
    for low, high in zip(edges[:-1].tolist(), edges[1:].tolist()):
        yield int(block[low]), pack.compress(b"".join(np.ascontiguousarray(entries[k][low:high], t).tobytes() for k, t in ENTRY))


def unpacked(blobs: list[bytes]) -> dict[str, np.ndarray]:
    unpack, width = zstandard.ZstdDecompressor(), sum(np.dtype(t).itemsize for _, t in ENTRY)
    columns = {k: [] for k, _ in ENTRY}
    for blob in blobs:
        data, at = unpack.decompress(blob), 0
        for k, t in ENTRY:
            end = at + len(data) // width * np.dtype(t).itemsize
            columns[k].append(np.frombuffer(data[at:end], t))
            at = end
    return {k: np.concatenate(v) for k, v in columns.items()}


def looked_up(rows: DataFrame, entries_of, blocks: int) -> DataFrame:
    """Every entry of the rows (doc, part, text, ...) that an earlier document holds, or that shares its first hash with others.

    ``entries_of(row, known)`` gives the entries of one row.
    """

    def send(batches):
        known, held, total = WordHashes(), [], 0

        def flush():
            entries = {k: np.concatenate([h[k] for h in held]) for k in held[0]}
            found = list(packed(entries, blocks))
            return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.binary())], ["block", "data"])

        for batch in pieces(batches):
            for row in batch.to_pylist():
                a, b, start, n = entries_of(row, known)
                if len(a):
                    held.append({"a": a, "b": b, "doc": np.full(len(a), row["doc"]), "part": np.full(len(a), row["part"]),
                                 "start": start.astype(np.int32), "n": n.astype(np.int32)})
                    total += len(a)
            if total > HELD:
                yield flush()
                held, total = [], 0
        if held:
            yield flush()

    def look_up(batches):
        blobs = [b for batch in batches for b in batch.column(1).to_pylist()]
        if not blobs:
            return
        every = unpacked(blobs)
        local = every["ref"] != every["doc"]
        heads, first = ranked({k: v[~local] for k, v in every.items()})
        reference = heads["doc"][first]
        kinds = first == np.arange(len(first))  # one for each pair of hashes
        run = np.cumsum(np.diff(heads["a"], prepend=heads["a"][:1] + np.uint64(1)) != 0) - 1
        several = np.bincount(run, weights=kinds)[run] > 1 if len(run) else kinds
        later = heads["doc"] > reference
        keep = later | several
        done = {k: np.concatenate([v[local], heads[k][keep]]) for k, v in every.items() if k not in ("a", "b", "ref")}
        refs = np.concatenate([every["ref"][local], reference[keep]])
        open_ends = np.concatenate([np.zeros(local.sum(), bool), ~later[keep]])
        for low in range(0, len(refs), 100_000):
            part = slice(low, low + 100_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array(done[k][part]) for k in ("doc", "part", "start", "n")] + [pa.array(refs[part]), pa.array(open_ends[part])],
                ["doc", "part", "start", "n", "reference", "several"])

    return rows.mapInArrow(send, "block int, data binary").repartition(blocks, "block").mapInArrow(look_up, FOUND)


def by_document(found: DataFrame, rows: DataFrame, name: str, how: str) -> DataFrame:
    """Rows of texts with their entries as a sorted list, no longer than the text has windows."""
    lists = found.groupBy("doc", "part").agg(F.sort_array(F.collect_list(F.struct("start", "n", "reference"))).alias(name))
    return rows.join(lists, ["doc", "part"], how)


def with_factors(df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """Rows (doc, part, text, factors): what each document shares with earlier ones.

    A factor is (start of its first window, number of windows, reference document).
    """
    spark, rows = df.sparkSession, keyed(df, doc_id, text)
    length = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-length // BLOCK_BYTES))
    none = (np.empty(0, np.uint64),) * 4

    def whole(row, known):
        words = (row["text"] or "").encode().split()
        return pieces_of(words, known, size) if len(words) >= size else none

    def single(row, known):
        return windows_of(row["text"].encode().split(), known, row["ends"], size)

    found = written(spark, looked_up(rows, whole, blocks), "pieces")
    ends = by_document(found.where("several"), rows, "ends", "inner")
    border = looked_up(ends, single, blocks).where("NOT several")
    return by_document(found.where("NOT several").unionByName(border), rows, "factors", "left")


def covered(found, n_words: int, size: int) -> np.ndarray:
    """Which words the factors cover."""
    edge = np.zeros(n_words + 1, np.int64)
    for f in found or ():
        edge[f["start"]] += 1
        edge[f["start"] + f["n"] + size - 1] -= 1
    return np.cumsum(edge)[:-1] > 0


def without_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """One row a document: id, number of words, words removed, what is kept (joined by one blank), factors."""
    rows = with_factors(df, doc_id, text, size).select("doc", "text", "factors")

    def run(batches):
        for batch in pieces(batches):
            totals, removed, kept = [], [], []
            for value, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = (value or "").encode().split()
                totals.append(len(words))
                if spans:
                    gone = covered(spans, len(words), size)
                    words = [w for w, g in zip(words, gone.tolist()) if not g]
                removed.append(totals[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), batch.column(2)],
                ["doc_id", "n_words", "n_removed", "kept_text", "factors"])

    out = rows.mapInArrow(
        run, "doc_id bigint, n_words bigint, n_removed bigint, kept_text string, factors array<struct<start: int, n: int, reference: bigint>>")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def op8_relative_lempel_ziv(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP8_SQL = f"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
win AS (SELECT doc_id, i, array_to_string(words[i:i + {SIZE - 1}], ' ') AS key
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - {SIZE - 1}, 0) + 1)) AS i FROM w)),
least AS (SELECT key, min(doc_id) AS d FROM win GROUP BY 1),
hit AS (SELECT win.doc_id, i FROM win JOIN least USING (key) WHERE d < win.doc_id),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM hit, range({SIZE}) r(j)),
word AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT w.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed,
  sha256(coalesce(kept.text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""
