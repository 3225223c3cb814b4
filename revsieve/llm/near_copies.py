"""Near-duplicates by order min-hash, verified by banded alignment.

A document's k-mers are its runs of ``K`` words, each labelled with how many equal ones came before it. For each of
``SKETCHES`` hash functions, the ``PICK`` labelled k-mers with the least hashes are sampled and kept in the order in
which they stand in the text: a sketch agrees only if the samples and their order do, which is what edits leave alone
and rearrangement does not. Two documents that share a sketch are candidates, if their sets of k-mers also have the Jaccard
similarity that scattered edits leave at ``SIMILAR`` (0.196 at 0.8). The alignment decides: they are linked if their words, aligned in
the band of diagonals that so few edits can reach, have an edit similarity (1 - edits / words of the longer one) of at
least ``SIMILAR``. Edits one by one at random break up to five k-mers each, so a pair at an edit similarity of 0.95 shares
a sketch with a probability of 0.999, one at 0.92 with 0.95, at 0.9 with 0.84 and at 0.85 with 0.43; edits in a row break fewer. Classes are the connected parts of the links.

Equal word sequences are one node from the start. Sketches are joined as a star to the least id of each, never as
pairs; the connected parts of these candidates are groups. A group of up to ``GROUP_WORDS`` words is resolved in one
place, over an index of its k-mers, comparing members with those not yet in a class. A larger group is resolved in
one pass for each sketch: documents that share it are one unit, and documents whose sketch lies in one class already are
left out. Where a sketch alone is above the limit, its documents first meet its least one, in parts; those that still lie in
several classes are then joined exactly. Candidates share one of their rarest k-mers (prefix filter: of n k-mers, the
first n - 0.196 n + 1 in one order of all k-mers), and the connected parts of that are compared whole, or, above the limit, every
part of them with every other one, save where both lie in one class. No pairs are written out.

Defined cases: a document without words (null, empty) is a class of its own; one of fewer than ``K`` words has one k-mer,
all its words; a null id comes before all others; repeated rows are in one class; other columns pass through.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revsieve.llm.common import columns, documents, fresh, pieces, ship
from revsieve.llm.words import WordHashes, joined, stirred
from revsieve.plans.lineage import new_dir

ship(__name__)

K = 5
SKETCHES = 24
PICK = 3
SIMILAR = 0.8
WORD_BINS = 128  # counts of words by hash, a bound on edits from below
GROUP_WORDS = 4_000_000
ORDER_SAMPLE = 2_000  # documents whose k-mers are counted for the order of the prefix filter; any order is exact
ORDER_GRAMS = 200_000
BROADCAST_ROWS = 300_000
NO_ID = -(2**63)


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    folder = new_dir(spark, name)
    df.write.parquet(folder)
    return spark.read.parquet(folder)


# -- sketches -------------------------------------------------------------------------


def kmers(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of ``k`` words, or of all words if there are fewer."""
    return joined(hashes, min(k, len(hashes))) if len(hashes) else hashes


def labelled(grams: np.ndarray) -> np.ndarray:
    """Hashes of k-mers with the number of equal ones before them."""
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    new = np.ones(len(grams), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    if new.all():
        return stirred(grams)
    place = np.arange(len(grams))
    count = np.empty(len(grams), np.uint64)
    count[order] = place - np.maximum.accumulate(np.where(new, place, 0))
    return stirred(grams + count * np.uint64(0xD6E8FEB86659FD93))


def sketches(grams: np.ndarray, seeds: np.ndarray, pick: int) -> np.ndarray:
    """One number for each seed: the ``pick`` least labelled k-mers, in text order."""
    values = labelled(grams)
    pick = min(pick, len(values))
    hashed = stirred(values[None, :] ^ seeds[:, None])
    if pick < len(values):
        places = np.sort(np.argpartition(hashed, pick - 1, axis=1)[:, :pick], axis=1)
    else:
        places = np.broadcast_to(np.arange(len(values)), hashed.shape)
    chosen = np.take_along_axis(hashed, places, axis=1)
    out = np.zeros(len(seeds), np.uint64)
    for j in range(pick):
        out = stirred(out * np.uint64(0x9E3779B97F4A7C15) + chosen[:, j])
    return out.view(np.int64)


def sketched(rows: DataFrame, k: int, count: int, pick: int) -> DataFrame:
    """A narrow row for each document: id, two hashes, number of words, sketches."""
    seeds = np.array([int.from_bytes(hashlib.blake2b(b"%d" % i, digest_size=8).digest(), "little") for i in range(count)], np.uint64)

    def run(batches):
        known = WordHashes()
        for batch in pieces(batches):
            keys, sizes, found = [], [], []
            for text in batch.column(2).to_pylist():
                words = (text or "").encode().split()
                keys.append(hashlib.blake2b(b" ".join(words), digest_size=16).digest())
                sizes.append(len(words))
                found.append(sketches(kmers(known.high_of(words), k), seeds, pick) if words else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int64()))],
                ["doc", "part", "words_key", "n", "sketches"])

    return rows.mapInArrow(run, "doc bigint, part bigint, words_key binary, n bigint, sketches array<bigint>")


# -- verification ---------------------------------------------------------------------


def within(a: list, b: list, limit: int) -> bool:
    """Whether at most ``limit`` edits (insert, delete, replace) turn one list into the other.

    Columns of the table of edits are bit vectors of the band, which holds ``limit`` diagonals on each side and slides along;
    the count on the diagonal of the goal never falls, so it ends the search once it is above the limit.
    """
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > limit:
        return False
    low, high = 0, 0
    while low < len(b) and a[low] == b[low]:
        low += 1
    while high < len(b) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    a, b = a[low : len(a) - high], b[low : len(b) - high]
    if not b:
        return len(a) <= limit
    common = set(b)
    places: dict = {}
    for i, w in enumerate(a):
        if w in common:
            places.setdefault(w, []).append(i)
    rows = {}
    for w, at in places.items():
        bits = bytearray(at[-1] // 8 + 1)
        for i in at:
            bits[i >> 3] |= 1 << (i & 7)
        rows[w] = int.from_bytes(bits, "little")
    band = (1 << (2 * limit + 1)) - 1
    goal = limit + len(a) - len(b)
    up, down, edits = band >> limit << limit, 0, len(a) - len(b)
    for j, w in enumerate(b):
        same = rows.get(w, 0)
        same = (same << (limit - j) if j < limit else same >> (j - limit)) & band
        straight = ((((same & up) + up) ^ up) | same | down) & band
        edits += not straight >> goal & 1
        if edits > limit:
            return False
        right = down | band & ~(straight | up)
        left = straight & up
        straight >>= 1
        up = left | band & ~(straight | right)
        down = straight & right
    return True


def scattered(similar: float, k: int) -> float:
    """The Jaccard similarity of k-mers that is left on average when edits, each for itself, spare a share ``similar`` of the words."""
    left = similar**k
    return left / (2 - left)


def classes(texts: list[str], k: int, similar: float, shared: float) -> np.ndarray:
    """For each of the texts, the place of the first member of its class."""
    known = WordHashes(200_000)
    hashes = [known.high_of(t.encode().split()) for t in texts]
    sets = [np.unique(kmers(h, k)) for h in hashes]
    sizes = np.array([len(s) for s in sets])
    lengths = np.array([len(h) for h in hashes])
    few = np.uint64(WORD_BINS - 1)
    counts = np.array([np.minimum(np.bincount((h & few).astype(np.int64), minlength=WORD_BINS), 32767) for h in hashes], np.int16)
    lists: dict[int, list] = {}
    label = np.full(len(texts), -1)
    left = np.arange(len(texts))

    def index(members):
        grams = np.concatenate([sets[i] for i in members])
        owners = np.repeat(members, sizes[members])
        order = np.argsort(grams, kind="stable")
        return grams[order], owners[order]

    def words(i):
        if i not in lists:
            lists[i] = texts[i].encode().split()
        return lists[i]

    grams, owners = index(left)
    indexed = len(left)
    for seed in range(len(texts)):
        if label[seed] >= 0:
            continue
        label[seed] = seed
        queue = [seed]
        while queue:
            x = queue.pop()
            low, high = np.searchsorted(grams, sets[x], "left"), np.searchsorted(grams, sets[x], "right")
            held = high - low
            at = np.repeat(low - np.concatenate([[0], np.cumsum(held)[:-1]]), held) + np.arange(held.sum())
            found = owners[at]
            common = np.bincount(found[label[found] < 0], minlength=len(texts))
            near = np.flatnonzero(common >= shared * (sizes[x] + sizes - common))
            near = near[(label[near] < 0) & (common[near] > 0)]
            limits = ((1 - similar) * np.maximum(lengths[near], lengths[x]) + 1e-9).astype(np.int64)
            apart = counts[near].astype(np.int32) - counts[x]  # no fewer edits than words too many or missing
            open_ = np.maximum(apart.clip(0).sum(axis=1), -apart.clip(None, 0).sum(axis=1)) <= limits
            for y, limit in zip(near[open_].tolist(), limits[open_].tolist()):
                if within(words(x), words(y), limit):
                    label[y] = seed
                    queue.append(y)
            lists.pop(x, None)
            left = left[label[left] < 0] if len(queue) % 16 == 0 else left
            if len(left) < indexed // 2:
                indexed = len(left)
                if not indexed:
                    return label
                grams, owners = index(left)
    return label


def resolved(rows: DataFrame, k: int, similar: float, shared: float) -> DataFrame:
    """(doc, label) from rows (unit, doc, words_key, text): the least id of a document's class in its unit."""
    spread = rows.repartition("unit").sortWithinPartitions("unit", "doc")

    def finish(docs, keys, texts):
        first: dict[bytes, int] = {}
        for i, key in enumerate(keys):
            first.setdefault(key, i)
        places = list(first.values())
        own = classes([texts[i] for i in places], k, similar, shared)
        heads = {key: docs[places[own[j]]] for j, key in enumerate(first)}
        return docs, [heads[key] for key in keys]

    def run(batches):
        unit, held = None, ([], [], [])
        for batch in pieces(batches):
            for u, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if u != unit and held[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in finish(*held)], ["doc", "label"])
                    held = ([], [], [])
                unit = u
                for column, value in zip(held, row):
                    column.append(value)
        if held[0]:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in finish(*held)], ["doc", "label"])

    return spread.select("unit", "doc", "words_key", "text").mapInArrow(run, "doc bigint, label bigint")


# -- connected parts ------------------------------------------------------------------


def connected(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(doc, label): the least id of each document's connected part, from edges (a, b). Edges are stored each round.

    Each round moves every neighbour of a document to the least one in sight, first the larger neighbours, then the others,
    until all edges point at the least document of their part.
    """
    edges = written(spark, edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        large = written(spark, large, "edges")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        edges = written(spark, moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("a").alias("doc"), F.col("b").alias("label"))
        before = state


def large_groups(spark, texts, big: DataFrame, count: int, k: int, similar: float, shared: float, limit: int) -> DataFrame:
    """(doc, label) for documents (doc, part, words_key, n, sketches) of groups above the limit, one sketch at a time.

    A sketch above the limit only meets its least document here; ``joined_by_rarest`` does the rest.
    """
    label = written(spark, big.select("doc", F.col("doc").alias("label")).distinct(), "labels")
    for at in range(count):
        here = big.withColumn("sketch", F.col("sketches")[at]).drop("sketches").join(label, "doc")
        open_ = here.groupBy("sketch").agg(
            F.min("doc").alias("head"), F.sum("n").alias("words"), F.min("label").alias("low"), F.max("label").alias("high"),
        ).where("low != high").select("sketch", "head", F.greatest(F.lit(1), F.ceil(F.col("words") / limit)).cast("int").alias("parts"))
        here = here.join(open_, "sketch")
        own = F.array(F.pmod(F.xxhash64("doc", F.lit(at)), F.col("parts")).cast("int"))
        slot = F.when(F.col("doc") == F.col("head"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(own)
        units = here.withColumn("slot", F.explode(slot)).withColumn("unit", F.xxhash64("sketch", "slot"))
        if units.isEmpty():
            continue
        found = resolved(units.join(texts, ["doc", "part"]), k, similar, shared)
        merged = connected(spark, found.select(F.col("doc").alias("a"), F.col("label").alias("b")).unionByName(
            label.select(F.col("doc").alias("a"), F.col("label").alias("b"))))
        label = written(spark, big.select("doc").distinct().join(merged, "doc", "left").select(
            "doc", F.coalesce("label", "doc").alias("label")), "labels")
    return label


def unmerged(big: DataFrame, label: DataFrame, limit: int) -> DataFrame:
    """(doc, part, words_key, n, label) of the documents that share a sketch above the limit with one of another class."""
    each = big.join(label, "doc").select("doc", "n", "label", F.posexplode("sketches").alias("at", "sketch"))
    open_ = each.groupBy("at", "sketch").agg(
        F.sum("n").alias("words"), F.min("label").alias("low"), F.max("label").alias("high"),
    ).where((F.col("words") > limit) & (F.col("low") != F.col("high"))).select("at", "sketch")
    docs = each.join(open_, ["at", "sketch"]).select("doc").distinct()
    return big.drop("sketches").join(docs, "doc").join(label, "doc")


def rarest(spark: SparkSession, rows: DataFrame, k: int, shared: float) -> DataFrame:
    """(doc, gram): of each row (doc, text), so many of its rarest k-mers that two texts with a Jaccard similarity of ``shared`` have one in common.

    K-mers are ordered by their count in a sample of the documents, then by hash.
    """
    def every(batches):
        known = WordHashes(200_000)
        for batch in pieces(batches):
            for text in batch.column(1).to_pylist():
                found = np.unique(kmers(known.high_of(text.encode().split()), k))
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], ["gram"])

    sample = rows.select("doc").distinct().orderBy(F.xxhash64("doc", F.lit("order")), "doc").limit(ORDER_SAMPLE)
    counts = rows.join(sample, "doc").select("doc", "text").mapInArrow(every, "gram bigint").groupBy("gram").agg(F.count(F.lit(1)).alias("c"))
    top = counts.where("c > 1").orderBy(F.desc("c"), "gram").limit(ORDER_GRAMS).toPandas()
    grams = top["gram"].to_numpy(np.int64).view(np.uint64)
    by = np.argsort(grams)
    sent = spark.sparkContext.broadcast((grams[by], top["c"].to_numpy(np.int64)[by]))

    def run(batches):
        known, (keys, values) = WordHashes(200_000), sent.value
        for batch in pieces(batches):
            docs, found = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.unique(kmers(known.high_of(text.encode().split()), k))
                count = np.zeros(len(own), np.int64)
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                    count = np.where(keys[at] == own, values[at], 0)
                size = len(own) - int(np.ceil(shared * len(own) - 1e-9)) + 1
                found.append(own[np.lexsort((own, count))[:size]])
                docs.append(np.full(len(found[-1]), doc, np.int64))
            if docs:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(docs)), pa.array(np.concatenate(found).view(np.int64))], ["doc", "gram"])

    return rows.select("doc", "text").mapInArrow(run, "doc bigint, gram bigint")


def paired_parts(docs: DataFrame, limit: int) -> DataFrame:
    """(unit, doc, part, words_key): documents of groups (group, doc, part, words_key, n, label) in units of about the limit.

    Any two documents of a group that lie in different classes are in some unit together. A class of more than half the limit
    is cut by document, the others of a group are put together by class; each two such halves are a unit, but two of one class are none.
    """
    half = max(1, limit // 2)
    sizes = docs.groupBy("group", "label").agg(F.sum("n").alias("words")).withColumn("large", F.col("words") > half)
    rest = sizes.where("not large").groupBy("group").agg(F.greatest(F.lit(1), F.ceil(F.sum("words") / half)).cast("int").alias("shares"))
    cut = sizes.join(rest, "group", "left").select(
        "group", "label", F.when(F.col("large"), F.col("label")).alias("whole"),
        F.when(F.col("large"), F.ceil(F.col("words") / half)).otherwise(F.col("shares")).cast("int").alias("shares"))
    share = F.pmod(F.xxhash64(F.when(F.col("whole").isNull(), F.col("label")).otherwise(F.col("doc"))), F.col("shares")).cast("int")
    dealt = docs.join(cut, ["group", "label"]).withColumn("half", F.xxhash64(F.coalesce(F.col("whole").cast("string"), F.lit("rest")), share))
    halves = dealt.groupBy("group", "half").agg(F.first("whole").alias("whole"))
    x, y = halves.select("group", F.col("half").alias("x"), F.col("whole").alias("wx")), halves.select("group", F.col("half").alias("y"), F.col("whole").alias("wy"))
    both = x.join(y, "group").where("x <= y and not coalesce(wx = wy, false)")
    both = both.select("group", F.xxhash64("group", "x", "y").alias("unit"), F.explode(F.array_distinct(F.array("x", "y"))).alias("half"))
    return dealt.join(both, ["group", "half"]).select("unit", "doc", "part", "words_key")


def joined_by_rarest(spark, texts, big: DataFrame, label: DataFrame, k: int, similar: float, shared: float, limit: int) -> DataFrame:
    """The labels after all similar documents that share a sketch above the limit have met."""
    left = written(spark, unmerged(big, label, limit), "unmerged")
    if left.isEmpty():
        return label
    prefixes = written(spark, rarest(spark, texts.join(left.select("doc", "part"), ["doc", "part"]), k, shared), "rarest")
    held = prefixes.groupBy("gram").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least != most")
    candidates = connected(spark, prefixes.join(held.drop("most"), "gram").select(F.col("doc").alias("a"), F.col("least").alias("b")))
    groups = candidates.unionByName(candidates.select(F.col("label").alias("doc"), "label").distinct()).distinct().withColumnRenamed("label", "group")
    left = written(spark, left.join(groups, "doc"), "unmerged")
    sizes = left.groupBy("group").agg(F.sum("n").alias("words"), F.min("label").alias("low"), F.max("label").alias("high")).where("low != high")
    sizes = written(spark, sizes.select("group", (F.col("words") > limit).alias("over")), "groups")
    whole = left.join(sizes.where("not over"), "group").select(F.col("group").alias("unit"), "doc", "part", "words_key")
    units = whole.unionByName(paired_parts(left.join(sizes.where("over"), "group").drop("over"), limit))
    found = resolved(units.join(texts, ["doc", "part"]), k, similar, shared)
    merged = connected(spark, found.select(F.col("doc").alias("a"), F.col("label").alias("b")).unionByName(
        label.select(F.col("doc").alias("a"), F.col("label").alias("b"))))
    return big.select("doc").distinct().join(merged, "doc", "left").select("doc", F.coalesce("label", "doc").alias("label"))


def near_classes(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K, count: int = SKETCHES, pick: int = PICK,
    similar: float = SIMILAR, limit: int = GROUP_WORDS, shared: float | None = None,
) -> DataFrame:
    """One row a row of the table: (doc, part, class), class being the least id in it; null ids are ``NO_ID``.

    ``shared`` is the least Jaccard similarity of candidates, by default what ``scattered`` edits leave.
    """
    shared = scattered(similar, k) if shared is None else shared
    spark, t = df.sparkSession, F.col(f"`{text}`")
    rows = df.select(F.coalesce(F.col(f"`{doc_id}`").cast("bigint"), F.lit(NO_ID)).alias("doc"), F.xxhash64(t).alias("part"), t.alias("text"))
    narrow = written(spark, sketched(rows, k, count, pick), "sketches")
    copies = narrow.where("n > 0").groupBy("words_key").agg(F.min("doc").alias("doc"))
    heads = narrow.join(copies, ["words_key", "doc"]).dropDuplicates(["words_key"])
    each = heads.select("doc", F.posexplode("sketches").alias("at", "sketch"))
    held = each.groupBy("at", "sketch").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least != most")
    stars = each.join(held.drop("most"), ["at", "sketch"]).select(F.col("doc").alias("a"), F.col("least").alias("b"))
    candidates = connected(spark, stars)
    groups = candidates.unionByName(candidates.select(F.col("label").alias("doc"), "label").distinct()).withColumnRenamed("label", "unit")
    members = written(spark, heads.join(groups, "doc"), "members")
    sizes = members.groupBy("unit").agg(F.sum("n").alias("words"))
    over = sizes.where(F.col("words") > limit).select("unit")
    small = members.join(over, "unit", "left_anti").select("unit", "doc", "part", "words_key")
    small = F.broadcast(small) if members.count() <= BROADCAST_ROWS else small
    labels = resolved(rows.join(small, ["doc", "part"]), k, similar, shared)
    labels = written(spark, labels, "labels")
    if not over.isEmpty():
        big = written(spark, members.join(over, "unit").select("doc", "part", "words_key", "n", "sketches"), "big")
        found = large_groups(spark, rows, big, count, k, similar, shared, limit)
        labels = labels.unionByName(joined_by_rarest(spark, rows, big, found, k, similar, shared, limit))
    of_words = copies.join(labels.where("doc != label"), "doc").select("words_key", "label")
    return (
        narrow.join(copies.withColumnRenamed("doc", "head"), "words_key", "left").join(of_words, "words_key", "left")
        .select("doc", "part", F.coalesce("label", "head", "doc").alias("class"))
    )


def one_of_each(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents whose id is the least of their class; of repeated ids, one row. All columns of the input."""
    id_name, part_name = fresh(df, "_doc", "_part")
    spark = df.sparkSession
    found = written(spark, near_classes(df, doc_id, text, **options).select(
        F.col("doc").alias(id_name), F.col("part").alias(part_name), (F.col("doc") != F.col("class")).alias("gone")), "classes")
    keyed = df.withColumns({
        id_name: F.coalesce(F.col(f"`{doc_id}`").cast("bigint"), F.lit(NO_ID)), part_name: F.xxhash64(F.col(f"`{text}`"))})
    key = [id_name, part_name]
    gone = written(spark, found.where("gone").select(*key).distinct(), "gone")
    left = keyed.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, key, "left_anti")
    twice = found.where("not gone").groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*key)
    if not twice.isEmpty():  # only then are texts shuffled
        left = left.join(twice, key, "left_anti").unionByName(left.join(twice, key, "left_semi").dropDuplicates(key))
    return left.select(*columns(df))


def op7_order_min_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_classes(documents(spark, sf_dir))
    return found.select(F.nullif("doc", F.lit(NO_ID)).alias("doc_id"), F.nullif("class", F.lit(NO_ID)).alias("class_id"))
