"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import pickle

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revsieve.plans.shipping import ship  # noqa: F401  (for the operators)

ship(__name__)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def share(spark: SparkSession, value):
    """Broadcast an object of this package; the function that comes back gives it to a task. Its size must be bounded."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(sent.value)


def held_out(doc_id: Column, parts: int, part: int = 2) -> Column:
    """Whether crc32 of the id as text leaves the remainder ``part``; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts)) == part, F.lit(False))


def pieces(batches, rows: int = 256):
    """Arrow batches cut into short ones, so that what a task holds at once stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def schema_with(df: DataFrame, *added: str) -> str:
    """DDL of a table's columns followed by ``added`` ones."""
    return ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema.fields), *added])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that the table doesn't have."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


def columns(df: DataFrame) -> list[Column]:
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]
