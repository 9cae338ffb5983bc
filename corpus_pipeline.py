"""The corpus pipeline: documents through five operators, each on all that the one before kept.

quality   documents that the classifier rejects go
copies    of documents linked by shingle similarity the one with the smallest doc_id stays
leaks     documents that hold a benchmark item go
mix       what is left is mixed to the sources' target weights; a row is a piece of a document, as often as it is used
tokens    the mix is written as token files; a row is a document's place there

Tables without rows pass through as such. Between stages the rows are a Parquet table in the shared folder.
quality and leaks, which end in Python, write it themselves: stage() limits the batches that go to the workers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridwise.llm import decontaminate, jaccard_join, mixing, quality_classifier, token_output
from gridwise.llm.common import read, stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stage(quality_classifier.accepted(docs, read(spark, sf_dir, "labels")), "pipeline-quality")


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stage(decontaminate.without_leaks(docs, read(spark, sf_dir, "benchmark")), "pipeline-leaks")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_output.token_digests(docs)


STAGES = [("quality", quality), ("copies", copies), ("leaks", leaks), ("mix", mix), ("tokens", tokens)]
#: Stages whose result is such a table already.
WRITTEN = ("quality", "leaks")

#: SQL can express neither the trained classifier nor the token files.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage_of in STAGES[:-1]:
        docs = stage_of(spark, docs, sf_dir)
        docs = docs if name in WRITTEN else stage(docs, f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
