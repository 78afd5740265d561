"""A training-corpus pipeline: quality, toxicity, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on all documents that its predecessor kept, and returns a
DataFrame; all but the last have the columns of ``documents``. ``run`` writes each stage's result to the shared
folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm import packing, pii, quality, simhash, toxicity
from maskwright.llm.common import stored
from maskwright.llm.queries import vocabulary


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, _labels(spark, sf_dir))


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go."""
    return toxicity.keep_clean(docs, _labels(spark, sf_dir))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id."""
    return simhash.keep_one(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Entities become surrogates; n_chars follows the new text."""
    masked = pii.replace(docs.toDF(*[f"c{k}" if c not in ("doc_id", "text") else c for k, c in enumerate(docs.columns)]))
    masked = masked.select(*[c if c in ("doc_id", "text") else F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of each document in sequences of 2048 tokens."""
    return packing.pack_documents(docs, vocabulary())


STAGES = [("quality", keep_good), ("toxicity", keep_clean), ("simhash", keep_one), ("pii", without_personal_data), ("packing", packed)]

#: SQL can't express the classifiers and tokens; tests check the stages and the whole run instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"stage-{name}")
    return docs
