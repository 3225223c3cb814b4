"""Stored tables with a key: the newest row of each, in buckets by a hash of the key.

A load adds its rows to the buckets they belong to, so what it reads and writes does not grow with the rest of the table. Older versions
stay until a bucket is compacted; reading leaves them out. Compacting writes the newest rows of some buckets aside, whole, and then replaces
just these buckets; if it is interrupted, doing it again starts from what lies aside. Loads have numbers, and loading the same rows once more under
the same number changes nothing. One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revsieve.operators.ranking import top_per_key

BUCKETS = 256
COMPACT_AFTER = 8  # loads in a bucket


class StoredTable:
    """Rows of ``schema`` under ``folder``; of equal ``key`` that with the greatest ``order``, and then of the last load, counts.

    Buckets go by the whole key, or by the columns ``by`` of it, so that rows with equal ones can be read together.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: list[str], order: list[str] = (), buckets: int = BUCKETS,
                 by: list[str] | None = None):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema
        self.key, self.order, self.buckets, self.by = list(key), list(order), buckets, list(by or key)
        self.columns = spark.createDataFrame([], schema).columns

    def with_bucket(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_bucket", F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)).cast("int"))

    def touched(self, df: DataFrame) -> list[int]:
        """Buckets of a table's keys: at most ``buckets`` numbers."""
        return sorted(r[0] for r in self.with_bucket(df.select(*self.by)).select("_bucket").distinct().collect())

    def append(self, rows: DataFrame, load: int) -> None:
        self._written(self.with_bucket(rows.select(*self.columns)).withColumn("_load", F.lit(load).cast("bigint")), f"{self.folder}/rows", "append")

    def upsert(self, rows: DataFrame, load: int) -> None:
        """Add the rows and compact the buckets that they belong to, which the table tells, so that rows are made only once."""
        self.append(rows, load)
        loaded = self.versions().where(F.col("_load") == load).select("_bucket").distinct()
        self.compact(sorted(r[0] for r in loaded.collect()), f"load-{load}")

    def versions(self, buckets: list[int] | None = None) -> DataFrame:
        """All stored versions, of some buckets only if these are named."""
        if not self._exists(f"{self.folder}/rows"):
            return self.spark.createDataFrame([], f"{self.schema}, _load bigint, _bucket int")
        rows = self.spark.read.schema(f"{self.schema}, _load bigint, _bucket int").parquet(f"{self.folder}/rows")
        return rows if buckets is None else rows.where(F.col("_bucket").isin(buckets))

    def _newest(self, versions: DataFrame) -> DataFrame:
        by = [F.col(c).desc_nulls_last() for c in [*self.order, "_load"]]
        return top_per_key(versions, self.key, by, 1, "_rn").drop("_rn")

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The newest row of each key."""
        return self._newest(self.versions(buckets)).select(*self.columns)

    def crowded(self, buckets: list[int], loads: int = COMPACT_AFTER) -> list[int]:
        """Those of the buckets that hold rows of more than ``loads`` loads."""
        counted = self.versions(buckets).groupBy("_bucket").agg(F.count_distinct("_load").alias("n"))
        return sorted(r[0] for r in counted.where(F.col("n") > loads).collect())

    def compact(self, buckets: list[int], name: str) -> None:
        """Leave only the newest rows in the buckets. ``name`` tells this from other compactions that may have been interrupted."""
        if not buckets:
            return
        aside = f"{self.folder}/aside/{name}"
        if not self._exists(f"{aside}/whole"):
            self._written(self._newest(self.versions(buckets)), f"{aside}/rows", "overwrite")
            self.spark.range(1).write.mode("overwrite").parquet(f"{aside}/whole")
        kept = self.spark.read.schema(f"{self.schema}, _load bigint, _bucket int").parquet(f"{aside}/rows")
        self._written(kept, f"{self.folder}/rows", "overwrite")
        self._path(aside)[0].delete(self._path(aside)[1], True)

    def _written(self, rows: DataFrame, folder: str, mode: str) -> None:
        """Rows of a bucket lie together, in several files if they are many; an overwrite replaces the buckets that it has."""
        from_aside = mode == "overwrite" and folder == f"{self.folder}/rows"  # where they lie together already
        (rows if from_aside else rows.hint("rebalance", "_bucket")).write.mode(mode).option(
            "partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(folder)

    def _path(self, folder: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _exists(self, folder: str) -> bool:
        files, path = self._path(folder)
        return files.exists(path)
