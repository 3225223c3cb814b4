"""Documents through the training-data operators, stage by stage.

Stages: quality rules (rejected documents and lines over the limit go), near-duplicates (one document of each class
stays), benchmark decontamination (documents that hold an item go), personal data (surrogates), token ids (the last stage:
one row a document with its ids and what they decode to). All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revsieve.llm import bpe, decontaminate, line_rules, near_copies, surrogates
from revsieve.llm.common import documents
from revsieve.plans.lineage import new_dir


def _measured(docs: DataFrame) -> DataFrame:
    """The table with the length of its texts as they are now."""
    return docs.withColumn("n_chars", F.length("text").cast("bigint"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _measured(line_rules.apply_rules(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_leaks(docs, decontaminate.benchmark(spark, sf_dir))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _measured(surrogates.with_surrogates(docs, surrogates.KEY))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    encoded = bpe.encode_decode(docs.select("doc_id", "text", "lang", "source"), bpe.default_path())
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("token_ids", token_ids),
]

#: Alignment, drawn surrogates and token ids are not for SQL; ``tests/llm`` compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each is written and read again before the next one starts."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        folder = new_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
