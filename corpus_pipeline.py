"""From raw documents to packed training sequences: quality rules, near duplicates, repeated
strings, source mix, packing. Each stage's rows are written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mcqflow.llm import jaccard, mixing, packing, quality, suffix
from mcqflow.llm.common import new_folder, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.keep_good(docs)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that the Jaccard join links."""
    return jaccard.keep_one(docs)


def remove_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings that stand elsewhere too."""
    return suffix.drop_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The runs of words that the mix takes of each document."""
    return mixing.mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in the sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", keep_good),
    ("ngram_jaccard_join", keep_one_of_near_copies),
    ("suffix_array_dedup", remove_repeated_strings),
    ("source_mixing", mix_sources),
    ("packing", pack_sequences),
]

# Draws, sequences and token ids are not expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
