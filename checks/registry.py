"""Named queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks import inputs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """Access to the driver's and the derived tables of one scale factor."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return inputs.table(self.spark, self.sf_dir, name)

    def newest(self, table: str, column: str) -> Column:
        """Largest value of a time column, as a literal."""
        return F.lit(self(table).agg(F.max(column)).first()[0])

    def stream(self, name: str) -> DataFrame:
        """A driver table as a stream of its files."""
        schema = self(name).schema
        return (
            self.spark.readStream.schema(schema)
            .option("pathGlobFilter", f"{name}.parquet").parquet(self.sf_dir)
        )


def tidy(df: DataFrame) -> DataFrame:
    """Plain comparable columns: long, rounded double, text."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = F.round(c.cast("double"), 6)
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def query(name: str, sql: str | None = None, needs: tuple[str, ...] = (), ctes: str = "",
          recursive: bool = False):
    def register(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            # the JVM never compiles a method of over 8,000 bytes; Spark then runs such a stage step by step, in methods that it does compile
            spark.conf.set("spark.sql.codegen.hugeMethodLimit", 8000)
            return tidy(fn(Tables(spark, sf_dir)))

        assert name not in QUERIES, name
        QUERIES[name] = run
        if sql is not None:
            parts = [p for p in (inputs.duckdb_ctes(*needs) if needs else "", ctes) if p]
            head = ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n" if parts else ""
            ORACLE[name] = head + sql
        return fn

    return register
