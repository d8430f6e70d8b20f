"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the docs of the next one. All but the last return the
columns of documents, whatever others there are and whatever they are called. An empty table
gives an empty one at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from batchloom.llm import leaks, neardups, packing, quality, repeats
from batchloom.llm.shared import cut, delete, scratch


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts.

    Null and blank texts go. Without a labelled document of either class there is no model, and all others
    stay. Repeated rows are judged alike; those without a doc_id are judged too, though they train nothing.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.train(docs, labels))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the least doc_id, and all others.

    Null and blank texts and rows without a doc_id are in no group and stay. Rows that repeat a doc_id are one document and stay or go together.
    """
    return neardups.keep_one(docs, neardups.near_groups(docs))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the later occurrences of repeated passages of 50 words or more; first is the least doc_id and place.

    A document left without a word goes. Shorter, blank and null texts and rows without a doc_id stay as they are. Rows that repeat a
    doc_id keep the same passages.
    """
    return repeats.cut_repeats(docs, repeats.repeated_spans(docs, method="sketch"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark.

    Each row is judged by its own text; null and blank ones stay. Without a benchmark item all stay.
    """
    return leaks.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bins of all pieces of all documents.

    Documents without words have a row without a bin; a null source is one source; repeated rows are packed one by one. Other columns aren't read.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("near-duplicates", near_dedup),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", best_fit_packing),
]

#: A trained model, signatures and alignments have no SQL; tests/llm hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        with scratch(spark):
            docs = cut(stage(spark, docs, sf_dir), keep=True)
        if before:
            delete(spark, before)
        before = docs.written_at
    return STAGES[-1][1](spark, docs, sf_dir)
