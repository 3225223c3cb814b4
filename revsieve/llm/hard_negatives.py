"""Hard-negative mining by exact search in Hilbert-ordered blocks with zone maps.

1. *Candidates.* Vectors become integers. Of rows with one label and vector only the first few ids can ever be returned, so
   only these are kept. They are sorted along a Hilbert curve through all dimensions and stored as Parquet, ``BLOCK`` rows a record, each
   with its zone map: the least and greatest value in every dimension, and of the labels.
2. *Bounds.* Interval arithmetic gives, for an anchor and a block, limits of the inner product: positive parts of the anchor meet the greatest
   values and negative parts the least ones, and the other way round. Tiles of anchors meet tiles of zone maps on a grid; only zone maps are read.
3. *Positives.* Each anchor first reads the blocks with the greatest bound of each tile of zone maps. What it finds there is a floor, and then it reads every
   block whose bound reaches that floor.
4. *Windows.* Each positive spans a window of scores. An anchor reads the blocks whose limits meet one of its windows, and the first rows of
   each window are returned. An anchor is sent to a block once, for all its windows.

The result is exact; the bounds only decide what is read. How much they rule out depends on the data: on unit vectors of 64 dimensions without
tight clusters the limits are wide and nearly every block is read (see the README), and the work is anchors times rows.

Defined cases: rows with a null id, label or vector, or a component that is null or not finite, take no part; rows equal in id, label and vector
count once; an anchor's other rows have another id; vectors of unlike length never meet; an empty vector has the score 0 with its like;
components and scores are integers below 2^62 in size; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revsieve.llm.common import ship
from revsieve.plans.lineage import new_dir

ship(__name__)

BLOCK = 2048
TILE = 1024
ZONES = 2048
#: Tiles of one kind in a cell of the grid.
CELL = 16
#: Bits of each dimension in the curve's index; scaled components from -256 up to 255 are told apart, the others fall in the outermost cells.
BITS = 6
FAR = 1 << 62
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95
VECTOR = "id bigint, label bigint, dim int, curve binary, vec binary"
RECORD = "block bigint, dim int, n int, least_label bigint, most_label bigint, low binary, high binary, ids binary, labels binary, vecs binary"
ZONE_TILE = "dim int, blocks binary, least_label binary, most_label binary, low binary, high binary"
ANCHOR_TILE = "dim int, anchors binary, ids binary, labels binary, vecs binary, lows binary, highs binary"
SLICE = "block bigint, dim int, anchors binary, ids binary, labels binary, vecs binary, lows binary, highs binary"
HIT = "anchor bigint, slot int, id bigint, score bigint"


# -- arrays ---------------------------------------------------------------------------


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of each row of cell numbers, as rows of bytes whose order is the curve's.

    The exchange and inversion of axes from the highest bit down, then a Gray code (Skilling's transposed form).
    """
    x = np.ascontiguousarray(cells.T).astype(np.uint32)
    dims = len(x)
    if not dims:
        return np.zeros((cells.shape[0], 1), np.uint8)
    for bit in range(bits - 1, 0, -1):
        low = np.uint32((1 << bit) - 1)
        for axis in x:
            invert = (axis >> np.uint32(bit)) & np.uint32(1) == 1
            swap = np.where(invert, 0, (x[0] ^ axis) & low).astype(np.uint32)
            x[0] ^= np.where(invert, low, swap)
            axis ^= swap
    for k in range(1, dims):
        x[k] ^= x[k - 1]
    flip = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> np.uint32(bit)) & np.uint32(1) == 1, np.uint32((1 << bit) - 1), np.uint32(0))
    x ^= flip
    digits = np.stack([(axis >> np.uint32(bit)) & np.uint32(1) for bit in range(bits - 1, -1, -1) for axis in x], axis=1)
    return np.packbits(digits.astype(np.uint8), axis=1)


def packed(matrix: np.ndarray) -> bytes:
    """Integers in two bytes each if all fit, else in eight."""
    small = matrix.size == 0 or -(1 << 15) <= matrix.min() and matrix.max() < 1 << 15
    return np.ascontiguousarray(matrix, np.int16 if small else np.int64).tobytes()


def unpacked(data: bytes, rows: int, columns: int) -> np.ndarray:
    width = len(data) // (rows * columns) if rows * columns else 8
    return np.frombuffer(data, np.int16 if width == 2 else np.int64).reshape(rows, columns)


def longs(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.int64)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of a and b; in floating point where that is exact."""
    if a.shape[1] == 0 or not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = a.shape[1] * float(np.abs(a.astype(np.float64)).max()) * float(np.abs(b.astype(np.float64)).max())
    if most < 2.0**52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def limits(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product that each row of a can have with a vector inside each box."""
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    return product(up, low) + product(down, high), product(up, high) + product(down, low)


# -- tables ---------------------------------------------------------------------------


def vectors(df: DataFrame, scale: float = 256.0, bits: int = BITS) -> DataFrame:
    """Rows (id, label, dim, curve, vec) of the usable rows of a table with the columns id, label and vector; each once."""

    def run(batches):
        for batch in batches:
            rows = batch.column(2).to_pylist()
            by_size: dict[int, list[int]] = {}
            for k, row in enumerate(rows):
                if None not in row:
                    by_size.setdefault(len(row), []).append(k)
            for dim, places in by_size.items():
                x = np.array([rows[k] for k in places], np.float64).reshape(len(places), dim)
                usable = np.isfinite(x).all(axis=1)
                q = np.floor(scale * x[usable]).astype(np.int64)
                half = 1 << (bits - 1)
                curve = hilbert(np.clip((q * half >> 8) + half, 0, 2 * half - 1), bits)
                at = pa.array(np.array(places, np.int64)[usable])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array(np.full(len(q), dim, np.int32)),
                     pa.array([c.tobytes() for c in curve], pa.binary()), pa.array([packed(v) for v in q], pa.binary())],
                    ["id", "label", "dim", "curve", "vec"])

    named = df.where("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL")
    usable = named.select(F.col("id").cast("bigint"), F.col("label").cast("bigint"), "vector")
    return usable.mapInArrow(run, VECTOR).groupBy("id", "label", "dim", "vec").agg(F.first("curve").alias("curve"))


def candidates(rows: DataFrame, kept: int) -> DataFrame:
    """The first ``kept`` ids of each label and vector: of rows that score alike with everything, no others are ever returned."""
    order = Window.partitionBy("label", "dim", "vec").orderBy("id")
    return rows.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= kept).drop("_k")


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows along the curve in records of at most ``size``, with their zone maps; ids ascend within a record."""

    def run(batches):
        from pyspark import TaskContext

        number, held, dim = TaskContext.get().partitionId() << 32, [], None

        def record():
            nonlocal number
            number += 1
            held.sort(key=lambda r: r[0])
            ids, labels = (np.array([r[k] for r in held], np.int64) for k in (0, 1))
            x = np.stack([np.frombuffer(r[2], np.int16 if len(r[2]) == 2 * dim else np.int64) for r in held]).astype(np.int64)
            low, high = (f(axis=0) if dim else np.empty(0, np.int64) for f in (x.min, x.max))
            values = [number, dim, len(held), int(labels.min()), int(labels.max()), low.tobytes(), high.tobytes(), ids.tobytes(), labels.tobytes(), packed(x)]
            return pa.RecordBatch.from_pylist([dict(zip(names, values))], schema)

        for batch in batches:
            for i, label, d, v in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if held and (d != dim or len(held) == size):
                    yield record()
                    held.clear()
                dim = d
                held.append((i, label, v))
        if held:
            yield record()

    names = [c.split(" ")[0] for c in RECORD.split(", ")]
    schema = pa.schema(list(zip(names, [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()] + [pa.binary()] * 5)))
    sort = ["dim", "curve", "vec", "label", "id"]
    return rows.repartitionByRange(*sort).sortWithinPartitions(*sort).select("id", "label", "dim", "vec").mapInArrow(run, RECORD)


def tiles(rows: DataFrame, row_schema: list[tuple[str, str]], schema: str, size: int) -> DataFrame:
    """Rows packed into records of at most ``size`` rows of one ``dim``.

    ``row_schema`` names the columns after ``dim`` and how each is written: long, bytes (int64 matrix rows), vec or longs (equal-length lists).
    """
    write = {
        "long": lambda column, dim: np.array(column, np.int64).tobytes(),
        "bytes": lambda column, dim: b"".join(column),
        "vec": lambda column, dim: packed(np.stack([np.frombuffer(v, np.int16 if len(v) == 2 * dim else np.int64) for v in column]).astype(np.int64)),
        "longs": lambda column, dim: np.array(column, np.int64).tobytes(),
    }
    columns = [c for c, _ in row_schema]

    def run(batches):
        held: dict[int, list[tuple]] = {}

        def record(dim):
            values = [write[kind](column, dim) for (_, kind), column in zip(row_schema, zip(*held.pop(dim)))]
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), *(pa.array([v], pa.binary()) for v in values)], names)

        for batch in batches:
            for dim, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                group = held.setdefault(dim, [])
                group.append(rest)
                if len(group) == size:
                    yield record(dim)
        for dim in list(held):
            yield record(dim)

    names = [c.split(" ")[0] for c in schema.split(", ")]
    return rows.select("dim", *columns).mapInArrow(run, schema)


def zone_tiles(stored: DataFrame) -> DataFrame:
    """Zone maps packed; reads no vectors."""
    kinds = [("block", "long"), ("least_label", "long"), ("most_label", "long"), ("low", "bytes"), ("high", "bytes")]
    return tiles(stored, kinds, ZONE_TILE, ZONES)


def anchor_tiles(anchors: DataFrame) -> DataFrame:
    """Anchors (anchor, id, label, dim, vec, lows, highs) packed; the two lists bound each anchor's windows and are equally long."""
    kinds = [("anchor", "long"), ("id", "long"), ("label", "long"), ("vec", "vec"), ("lows", "longs"), ("highs", "longs")]
    return tiles(anchors, kinds, ANCHOR_TILE, TILE)


def grid(left: DataFrame, right: DataFrame, on: str, left_cells: int, right_cells: int) -> DataFrame:
    """Every row of one side with every row of the other that has the same ``on``, dealt to cells of about equal size."""
    def cell(side: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        dealt = side.withColumn(own, F.pmod(F.xxhash64(*side.columns), F.lit(n)))
        return dealt.withColumn(other, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(m - 1).cast("bigint"))))

    a = cell(left, "_l", left_cells, "_r", right_cells)
    b = cell(right, "_r", right_cells, "_l", left_cells)
    return a.join(b, [on, "_l", "_r"]).drop("_l", "_r")


# -- search ---------------------------------------------------------------------------


def chosen(anchors: DataFrame, zones: DataFrame, same: bool, first: bool = False) -> DataFrame:
    """Slices of anchors for each block that they must read.

    ``same`` asks for rows of an anchor's label, else for rows of other ones. With ``first`` only the block of the greatest limit is chosen for each
    anchor and tile of zone maps.
    """

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                dim, ids, labels, numbers = row["dim"], longs(row["ids"]), longs(row["labels"]), longs(row["blocks"])
                n = len(ids)
                a = unpacked(row["vecs"], n, dim)
                lows, highs = (longs(row[k]).reshape(n, -1) for k in ("lows", "highs"))
                least, most = limits(a.astype(np.int64), *(longs(row[k]).reshape(len(numbers), dim) for k in ("low", "high")))
                least_label, most_label = longs(row["least_label"]), longs(row["most_label"])
                inside = (labels[:, None] >= least_label) & (labels[:, None] <= most_label)
                need = inside if same else ~(inside & (least_label == most_label))
                if first:
                    best = np.where(need, most, -FAR)
                    top = best.argmax(axis=1)
                    only = np.zeros_like(need)
                    only[np.arange(n), top] = need[np.arange(n), top]
                    need = only
                else:
                    meets = np.zeros_like(need)
                    for w in range(lows.shape[1]):
                        meets |= (most >= lows[:, w : w + 1]) & (least <= highs[:, w : w + 1]) & (lows[:, w] <= highs[:, w])[:, None]
                    need &= meets
                for k in np.flatnonzero(need.any(axis=0)).tolist():
                    at = np.flatnonzero(need[:, k])
                    values = [longs(row["anchors"])[at].tobytes(), ids[at].tobytes(), labels[at].tobytes(), packed(a[at]), lows[at].tobytes(), highs[at].tobytes()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([numbers[k]], pa.int64()), pa.array([dim], pa.int32()), *(pa.array([v], pa.binary()) for v in values)], names)

    names = [c.split(" ")[0] for c in SLICE.split(", ")]
    cells = [-(-side.count() // CELL) or 1 for side in (anchors, zones)]
    return grid(anchors, zones, "dim", *cells).mapInArrow(run, SLICE)


def read(slices: DataFrame, stored: DataFrame, same: bool, top: int) -> DataFrame:
    """Rows (anchor, slot, id, score): in each block, the first ``top`` rows of each window of each anchor sent there."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                dim, ids, labels = row["dim"], longs(row["row_ids"]), longs(row["row_labels"])
                x = unpacked(row["row_vecs"], len(ids), dim)
                anchors, own, own_labels = longs(row["anchors"]), longs(row["ids"]), longs(row["labels"])
                a = unpacked(row["vecs"], len(own), dim)
                lows, highs = (longs(row[k]).reshape(len(own), -1) for k in ("lows", "highs"))
                for start in range(0, len(own), 256):
                    part = slice(start, start + 256)
                    like = own_labels[part, None] == labels
                    open_ = (like if same else ~like) & (own[part, None] != ids)
                    scores = np.where(open_, product(a[part], x), -FAR)
                    for w in range(lows.shape[1]):
                        low, high = lows[part, w], highs[part, w]
                        left = np.where(scores <= high[:, None], scores, -FAR) if (high < FAR).any() else scores.copy()
                        lines = np.arange(len(left))
                        for _ in range(top):
                            at = left.argmax(axis=1)  # the first of equal scores, so the least id
                            score = left[lines, at]
                            found = (score >= low) & (score > -FAR)
                            if not found.any():
                                break
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(anchors[part][found]), pa.array(np.full(found.sum(), w, np.int32)), pa.array(ids[at[found]]), pa.array(score[found])],
                                ["anchor", "slot", "id", "score"])
                            left[lines, at] = -FAR

    tasks = int(stored.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, much work: not to be put together by size
    rows = stored.select("block", F.col("ids").alias("row_ids"), F.col("labels").alias("row_labels"), F.col("vecs").alias("row_vecs"))
    return slices.repartition(tasks, "block").join(rows.repartition(tasks, "block"), "block").mapInArrow(run, HIT)


def best(hits: DataFrame, top: int) -> DataFrame:
    """The first ``top`` hits of each window, ranked."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def written(df: DataFrame, name: str) -> DataFrame:
    folder = new_dir(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def mined(
    df: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
    scale: float = 256.0, block: int = BLOCK,
) -> DataFrame:
    """Hard negatives of a table with the columns id, label and vector.

    Scores are inner products of components times ``scale``, rounded down. For each row with ``is_anchor`` (a condition on id and label) and each of
    its first ``positives`` rows of the same label, the first ``negatives`` rows of other labels whose score is ``low`` to ``high`` per cent
    of the positive's.
    """
    rows = written(vectors(df, scale), "vectors")
    stored = written(blocks(candidates(rows, max(positives + 1, negatives)), block), "blocks")
    zones = written(zone_tiles(stored), "zones")
    anchors = written(rows.where(is_anchor).withColumn("anchor", F.monotonically_increasing_id()), "anchors").drop("curve")

    def with_windows(lows: Column, highs: Column, bounds: DataFrame | None = None) -> DataFrame:
        table = anchors.join(bounds, "anchor", "left") if bounds else anchors
        return written(anchor_tiles(table.select("anchor", "id", "label", "dim", "vec", lows.alias("lows"), highs.alias("highs"))), "tiles")

    none, most = F.array(F.lit(-FAR)), F.array(F.lit(FAR))
    first = best(read(chosen(with_windows(none, most), zones, True, first=True), stored, True, positives), positives)
    floor = first.where(F.col("rank") == positives).select("anchor", F.array("score").alias("floor"))
    reach = with_windows(F.coalesce("floor", none), most, floor)
    found = written(best(read(chosen(reach, zones, True), stored, True, positives), positives).drop("slot"), "positives")

    score = F.col("score").cast("decimal(20,0)")
    lower, upper = (f(F.lit(share) * score / F.lit(100)).cast("bigint") for f, share in ((F.ceil, low), (F.floor, high)))
    slots = F.sequence(F.lit(1), F.lit(positives))
    windows = found.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("rank", F.struct(lower.alias("low"), upper.alias("high"))))).alias("w"))
    ask = with_windows(F.transform(slots, lambda k: F.coalesce(F.col("w")[k]["low"], F.lit(1).cast("bigint"))),
                       F.transform(slots, lambda k: F.coalesce(F.col("w")[k]["high"], F.lit(0).cast("bigint"))), windows)
    hits = best(read(chosen(ask, zones, False), stored, False, negatives), negatives)
    pairs = found.select("anchor", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = hits.withColumnsRenamed({"id": "negative_id", "score": "negative_score"}).join(pairs, ["anchor", "slot"])
    return out.join(anchors.select("anchor", F.col("id").alias("anchor_id")), "anchor").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hilbert_zone_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table.select(F.col("vec_id").alias("id"), label.alias("label"), F.col("embedding").alias("vector"))
    return mined(rows, F.col("id") % 50 == 0)


OP12_SQL = f"""WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * x::DOUBLE) FOR x IN embedding] AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS a, b.id AS b, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 50 = 0),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= {POSITIVES}),
n AS (SELECT p.a, p.b, p.score AS ps, s.b AS n, s.score AS ns,
    row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS rank
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND {LOW} * p.score <= 100 * s.score AND 100 * s.score <= {HIGH} * p.score)
SELECT a AS anchor_id, b AS positive_id, rank::INT AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score
FROM n WHERE rank <= {NEGATIVES}"""
