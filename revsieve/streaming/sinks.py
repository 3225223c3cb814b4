"""Running streams into tables under the shared folder, and reading those back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revsieve.operators.ranking import top_per_key
from revsieve.plans.lineage import new_dir
from revsieve.plans.review import ReviewSettings, review
from revsieve.sources.stored import BUCKETS, COMPACT_AFTER, StoredTable
from revsieve.streaming.expiring import rocks_state


def append_table(stream: DataFrame, folder: str, checkpoint: str, available_now: bool = True):
    """Append-only stream to parquet files, exactly once."""
    writer = stream.writeStream.format("parquet").outputMode("append").option(
        "path", folder
    ).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def batch_table(stream: DataFrame, folder: str, checkpoint: str, mode: str = "update",
                transform: Callable[[DataFrame], DataFrame] | None = None,
                available_now: bool = True):
    """Every micro-batch as its own folder, so a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        out = transform(batch) if transform else batch
        out.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    writer = stream.writeStream.outputMode(mode).option(
        "checkpointLocation", checkpoint
    ).foreachBatch(write)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def newest_rows(spark: SparkSession, folder: str, schema, keys: list[str]) -> DataFrame:
    """Last emitted row per key of an update-mode stream."""
    rows = spark.read.schema(f"{schema}, batch long").parquet(folder)
    return top_per_key(rows, keys, [F.col("batch").desc()], 1, "_rn").drop("_rn", "batch")


def change_store(spark: SparkSession, folder: str, schema: str, buckets: int = BUCKETS) -> StoredTable:
    """The file changes that a review stream has seen, in buckets by pull request."""
    return StoredTable(spark, f"{folder}/diffs", schema, ["pr_id", "file_ord", "file_path"], [], buckets, ["pr_id"])


def review_stream(diffs: DataFrame, folder: str, checkpoint: str,
                  settings: ReviewSettings | None = None, available_now: bool = True,
                  buckets: int = BUCKETS, compact_after: int = COMPACT_AFTER):
    """Review arriving file changes; a pull request's changes may be spread over arrivals.

    Each micro-batch is added to the store, and the pull requests it touches are reviewed anew from all their stored
    changes (the newest of each file). Only the buckets of these pull requests are read, and those that hold
    changes of many arrivals are compacted. ``current_reviews`` reads the last review of each.
    """
    schema = _ddl(diffs)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        store = change_store(spark, folder, schema, buckets)
        store.append(batch, batch_id)
        batch.select("pr_id").distinct().write.mode("overwrite").parquet(f"{folder}/touched/batch={batch_id}")
        touched = spark.read.schema("pr_id string").parquet(f"{folder}/touched/batch={batch_id}")
        places = store.touched(touched)
        known = store.read(places).join(touched, "pr_id", "left_semi")
        review(known, settings=settings).write.mode("overwrite").parquet(f"{folder}/rows/batch={batch_id}")
        store.compact(store.crowded(places, compact_after), f"batch-{batch_id}")

    writer = diffs.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def current_reviews(spark: SparkSession, folder: str) -> DataFrame:
    """The last review of each pull request that a review stream has seen."""
    last = spark.read.parquet(f"{folder}/touched").groupBy("pr_id").agg(F.max("batch").alias("batch"))
    return spark.read.parquet(f"{folder}/rows").join(last, ["pr_id", "batch"], "left_semi").drop("batch")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def collect_append(stream: DataFrame, name: str) -> DataFrame:
    """Run to the end of the available input; the emitted rows as a table."""
    spark = stream.sparkSession
    folder = new_dir(spark, name)
    append_table(stream, f"{folder}/rows", f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def collect_state(stream: DataFrame, name: str) -> DataFrame:
    """Like ``collect_append``, for streams with state of their own."""
    with rocks_state(stream.sparkSession):
        return collect_append(stream, name)


def collect_update(stream: DataFrame, name: str, keys: list[str]) -> DataFrame:
    spark = stream.sparkSession
    folder = new_dir(spark, name)
    batch_table(stream, f"{folder}/rows", f"{folder}/checkpoint").awaitTermination()
    return newest_rows(spark, f"{folder}/rows", _ddl(stream), keys)


def collect_reviews(diffs: DataFrame, name: str, settings: ReviewSettings | None = None) -> DataFrame:
    spark = diffs.sparkSession
    folder = new_dir(spark, name)
    review_stream(diffs, folder, f"{folder}/checkpoint", settings).awaitTermination()
    return current_reviews(spark, folder)
