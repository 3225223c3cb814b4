"""Rendezvous hashing of stable record keys over weighted shards, with gapless slots.

Every (key, shard) pair draws a number in (0, 1) from a hash; the shard with the largest
``-weight / ln(number)`` gets the key. Adding a shard adds one more draw and changes no other,
so keys move into the new shard only, and each shard gets its share by weight.

Inside a shard, rows are numbered by (bucket, key, checksum, size), where the bucket is a further
part of the key's hash. Only the counts of ``BUCKETS`` buckets a shard are added up in one place;
rows themselves meet bucket by bucket. Repeated rows are counted before they are shuffled and
written out again in chunks, so a row that fills a third of the table is no hot task.

Defined cases: a null key is hashed as the text ``null key`` and so goes to one shard; a null text has
size 1 and checksum 0; equal rows get different slots; an empty table gives no rows; columns of the
input other than key and text are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revsieve.llm.common import documents

BUCKETS = 4096
CHUNK = 4096
SHARDS = 8


def _digest(key: Column, what: str) -> Column:
    return F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null key")), F.lit(what)).cast("binary"))


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """Number of the shard that a key belongs to; ``weights`` has one positive weight a shard."""
    if not weights or any(w <= 0 for w in weights):
        raise ValueError("every shard needs a positive weight")
    draws = []
    for shard, weight in enumerate(weights):
        bits = F.conv(F.substring(_digest(key, f"/{shard}"), 1, 13), 16, 10).cast("bigint")
        unit = (bits.cast("double") + 0.5) / float(2**52)
        draws.append(F.struct((-F.lit(float(weight)) / F.ln(unit)).alias("score"), F.lit(-shard).alias("shard")))
    return -F.array_max(F.array(*draws))["shard"]


def place(df: DataFrame, key: str, weights: Sequence[float], shard: str = "shard") -> DataFrame:
    """The table with one more column: each row's shard. No shuffle."""
    return df.withColumn(shard, shard_of(F.col(f"`{key}`"), weights))


def shard_table(df: DataFrame, key: str, text: str, weights: Sequence[float], new_weight: float = 1.0) -> DataFrame:
    """One row a record: key, size, checksum, shard, slot in the shard, and the shard after one more is added."""
    k, t = F.col(f"`{key}`"), F.col(f"`{text}`")
    bucket = F.conv(F.substring(_digest(k, ""), 1, 3), 16, 10).cast("int")
    shard = shard_of(k, weights)
    rows = df.select(
        k.alias("key"),
        (F.coalesce(F.octet_length(t), F.lit(0)).cast("bigint") + 1).alias("size"),
        F.crc32(F.coalesce(t, F.lit("")).cast("binary")).alias("text_crc32"),
    )
    same = rows.groupBy("key", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    key_col = F.col("key")
    same = same.withColumns({
        "shard": shard_of(key_col, weights), "bucket": F.conv(F.substring(_digest(key_col, ""), 1, 3), 16, 10).cast("int"),
        "grown_shard": shard_of(key_col, [*weights, new_weight]),
    })
    before = Window.partitionBy("shard", "bucket").orderBy("key", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    inside = same.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    # at most len(weights) * BUCKETS rows, read from the key column alone
    totals = df.select(shard.alias("shard"), bucket.alias("bucket")).groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("total"))
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("shard", "bucket", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("offset"))
    placed = inside.join(F.broadcast(offsets), ["shard", "bucket"]).withColumn("first", F.col("start") + F.col("offset"))
    chunks = placed.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.expr(f"(n - 1) div {CHUNK}")))).hint("rebalance")
    low = F.col("first") + F.col("chunk") * CHUNK
    return chunks.select(
        "key", "size", "text_crc32", "shard",
        F.explode(F.sequence(low, F.least(low + CHUNK, F.col("first") + F.col("n")) - 1)).alias("slot"), "grown_shard",
    )


def op1_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_table(documents(spark, sf_dir), "doc_id", "text", [1.0] * SHARDS)
    return out.select(
        F.col("key").alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard",
    )


def _best(shards: int) -> str:
    draws = ", ".join(
        f"{{'score': -1.0::DOUBLE / ln((('0x' || substr(md5(key || '/{s}'), 1, 13))::BIGINT::DOUBLE + 0.5) / {2**52}.0::DOUBLE), 'shard': {-s}}}"
        for s in range(shards)
    )
    return f"(-(list_max([{draws}]).shard))::INTEGER"


#: The checksum is CRC-32 bit by bit: the table of 256 values follows from the polynomial.
OP1_SQL = f"""WITH RECURSIVE steps(b, i, v) AS (
  SELECT b, 0, b::BIGINT FROM range(256) r(b)
  UNION ALL SELECT b, i + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM steps WHERE i < 8),
crc_table AS (SELECT list(v ORDER BY b) AS t FROM steps WHERE i = 8),
bytes AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
sums AS (SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(range(1, length(h), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT)),
    lambda a, b: xor(a // 256, t[xor(a, b) % 256 + 1])), 4294967295) AS text_crc32
  FROM bytes, crc_table),
keyed AS (SELECT *, coalesce(doc_id::VARCHAR, 'null key') AS key FROM sums),
placed AS (SELECT doc_id, size::BIGINT AS size, text_crc32, {_best(SHARDS)} AS shard, {_best(SHARDS + 1)} AS grown_shard,
  substr(md5(key), 1, 3) AS bucket FROM keyed)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard
FROM placed"""
