"""Training-corpus pipeline: from documents to token-id records, in five stages.

Each stage reads what its predecessor kept, as a written table, and hands on the columns of documents; the
last returns what it reads back from the record files. Stages that compare documents, or take them more or
less often, decide in small tables of ids; texts cross no shuffle for it while those tables are small enough
to be sent to every task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import decontaminate, language, mixing, records, shinglejoin
from docloom.llm.shared import bounded_batches, table, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null, or no letter) go."""
    bounded_batches(spark)
    return language.in_a_language(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that near-copies link, one stays."""
    bounded_batches(spark)
    return shinglejoin.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a passage with the benchmark go."""
    bounded_batches(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for."""
    bounded_batches(spark)
    return mixing.mixed_documents(docs)


def token_records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-id records of all that is left, read back from their files."""
    bounded_batches(spark)
    return records.token_records(docs)


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", jaccard_join),
    ("benchmark decontamination", decontamination),
    ("mixing sources", mixing_sources),
    ("token-ID output", token_records),
]
#: SQL can express neither a language model's parse nor a balanced draw; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{k}")
    return docs
