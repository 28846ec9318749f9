"""The corpus pipeline: grade, deduplicate, decontaminate, pseudonymise, pack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from motifline.llm import decontam, neardup, pii, quality, queries
from motifline.session import discard, few_tasks, materialize, scratch


def dealt(docs: DataFrame) -> DataFrame:
    """A written table in no more tasks than its rows need: every task and file has processes started, see ``session``."""
    return few_tasks(docs, docs.count())


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that the quality classifier accepts."""
    docs = dealt(docs)
    return quality.select_documents(docs, quality.fit(docs, queries.table(spark, sf_dir, "labels"), quality.rating(), 2))


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: one document of each near-duplicate group (five-word shingles, similarity 0.8)."""
    return neardup.drop_near_duplicates(dealt(docs), shingle=5, percent=80)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that are not contaminated by the benchmark."""
    return decontam.decontaminate(dealt(docs), queries.table(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: personal data and secrets replaced by surrogates."""
    return pii.pseudonymise(dealt(docs), queries.SURROGATE_KEY)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: pieces of all documents with their place in sequences."""
    return few_tasks(queries.packed(dealt(docs)), docs.count())


STAGES = [("quality", good), ("near_duplicates", unique), ("decontamination", clean), ("surrogates", private), ("packing", packed)]

#: Classifier, surrogates and tokens are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each result written and read again; what a stage wrote besides is deleted."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        last = docs
        with scratch() as kept:
            docs = materialize(stage(spark, last, sf_dir), name)
            kept.add(docs)
        discard(last)
    return STAGES[-1][1](spark, docs, sf_dir)
