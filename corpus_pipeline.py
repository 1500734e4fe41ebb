"""Corpus pipeline: five stages over `documents`, each over all that its predecessor kept.

Every stage but the last returns the columns of documents; each stage's rows are written as Parquet to shared storage and read
again. The last stage returns the packing of the documents that are left.

Defined cases: null and empty texts, and those of under ten words, go with the quality rules; a null id keeps its row; equal rows are
near duplicates of each other, one stays; columns beside those of documents pass through unchanged, whatever their names; an empty
table gives an empty packing; without labels the classifier keeps all, and the rules' bands come from all documents; without benchmark items
nothing is taken for a leak. SQL cannot express the stages: each is held against brute force in the tests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from polyad.llm import cotrain, decontam, packing, perplexity, simhash
from polyad.llm.common import materialise

#: SQL cannot express the classifier, the language model, the fingerprints or the packing; tests hold them against brute force.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Train on the labels of the documents at hand; those classified as bad go."""
    model = cotrain.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return cotrain.passing(docs, model)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie outside their language's perplexity band go."""
    return perplexity.passing(docs, labels=spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of SimHash near duplicates stays."""
    return simhash.deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark text go."""
    return decontam.clean_of(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("pack", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
