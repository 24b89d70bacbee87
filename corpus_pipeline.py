"""From raw documents to token files: quality rules, near-duplicates, decontamination, mixing, token output.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; between stages the documents
are written as Parquet and read again. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from functools import wraps
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from sitegauge.llm import decontamination, minhash, mixing, quality_rules
from sitegauge.llm.common import read_table
from sitegauge.llm.queries import MIXTURE, token_output
from sitegauge.session import ensure_checkpoint_dir


#: Session settings while the stages run. Every task writes whole documents, and holds a row group until it is full; every
#: Python worker holds a batch of texts. Both are kept small, so that the memory of an executor does not depend on the texts.
SETTINGS = {"parquet.block.size": str(8 << 20), "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


def with_settings(stage):
    """The stage, run under SETTINGS; they stay, as its result is written after it returns."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for name, value in SETTINGS.items():
            spark.conf.set(name, value)
        return stage(spark, docs, sf_dir)

    return run_stage


@with_settings
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the fences of their language and source reject go."""
    return quality_rules.passing(docs)


@with_settings
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, of a similarity of 0.8 or more over five words, stays."""
    return minhash.without_duplicates(docs, 80, 100)


@with_settings
def decontamination_(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a question of the benchmark go."""
    return decontamination.clean(docs, read_table(spark, sf_dir, "benchmark"))


@with_settings
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are repeated to their target weights; no document is left out."""
    return mixing.mixed(docs, MIXTURE)


@with_settings
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files; returns each document's place in them and the checksum of its ids."""
    return token_output(spark, docs)


STAGES = [
    ("quality rules", quality),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination_),
    ("mixing to target weights", mixture),
    ("token-ID output", tokens),
]

#: Signatures, templates and the tokenizer can't be expressed in SQL; tests/llm hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
