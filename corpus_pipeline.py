"""The corpus pipeline: five stages from documents to token files.

Each stage takes (spark, docs, sf_dir), works on all that the stage before has kept and returns a DataFrame; its
rows are written as Parquet and read again as the next stage's docs. All stages but the last return the columns of
``documents``; the last returns what the written token files hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sweepline.llm.common import materialize, table
from sweepline.llm.decontaminate import without_leaks
from sweepline.llm.mixing import mixed
from sweepline.llm.simhash import one_of_each_group
from sweepline.llm.token_files import token_output
from sweepline.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are predicted toxic."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    return one_of_each_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of the benchmark."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that sources come near their target sizes."""
    return mixed(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes token files and returns their documents as read back."""
    return token_output(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_files", token_files),
]

#: The learned and hashed stages can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
