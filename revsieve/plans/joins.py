"""Join helpers for sides whose size or spread is not known in advance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 20_000
BROADCAST_BYTES = 32_000_000
SALTS = 64


def fits(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a side has few rows and bytes (as JSON); looks at no more than ``max_rows`` of it."""
    written = F.octet_length(F.to_json(F.struct("*")))
    rows, size = df.limit(max_rows + 1).select(written.alias("b")).agg(F.count(F.lit(1)), F.sum("b")).first()
    return rows <= max_rows and (size or 0) <= max_bytes


def join_small(
    left: DataFrame, small: DataFrame, on, how: str = "inner",
    max_rows: int = BROADCAST_ROWS, salt_keys: list[str] | None = None,
) -> DataFrame:
    """Broadcast ``small`` when its checked size allows it, else spread hot keys by salt.

    ``on`` names shared columns. In the salted form every row of ``left`` takes one
    of ``SALTS`` salts from ``salt_keys`` and ``small`` is repeated once per salt, so
    one key's rows land in many tasks.
    """
    if fits(small, max_rows):
        return left.join(F.broadcast(small), on, how)
    keys = [on] if isinstance(on, str) else list(on)
    return salted_join(left, small, keys, how, salt_keys or left.columns[:1])


def salted_join(
    left: DataFrame, right: DataFrame, on: list[str], how: str, salt_keys: list[str],
    salts: int = SALTS,
) -> DataFrame:
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(*salt_keys), F.lit(salts)).cast("int"))
    repeated = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")
