"""A training corpus from raw documents: language, near-duplicates, personal data, mixture, packing.

``STAGES`` lists the steps; each takes (spark, docs, sf_dir), works on all rows of its predecessor's result, which
``run`` writes as Parquet and reads again, and returns the columns of ``documents`` (the last one: packed pieces).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sunframe.llm import curriculum, langid, pii, retrieval_packing, simhash
from sunframe.llm.tools import Scratch


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go."""
    return langid.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: three-word shingles, fingerprints at three or fewer differing bits."""
    return simhash.keep_representatives(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return pii.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights, repeated or cut, in training order."""
    return curriculum.mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token windows of documents that resemble each other."""
    return retrieval_packing.pack_report(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data),
          ("mixture", mixture), ("packing", packing)]

#: Trained models and BPE tokens cannot be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages, each written and read again."""
    scratch = Scratch(spark, "corpus")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if i:
            scratch.drop(STAGES[i - 1][0])
    return docs
