"""The pipeline from raw documents to packed training sequences, one operator a stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from footfall.llm import minhash_dedup, packing, quality_gbt, source_mix, suffix_dedup
from footfall.llm.common import new_path, table, tokenizer_file

# A property of text cut by code (scores, packing) has no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def good_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text the quality classifier doesn't reject."""
    return quality_gbt.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates (five-word shingles, likeness 0.8 or more)."""
    return minhash_dedup.keep_one(docs, 80)


def no_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 bytes and more that a document with a smaller id has too."""
    return suffix_dedup.without_repeats(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of the sources takes them."""
    return source_mix.mixed(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed in sequences of 4096 tokens."""
    return packing.pack_texts(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", good_texts),
    ("near_duplicates", one_of_each),
    ("repeated_passages", no_repeats),
    ("source_mix", mixture),
    ("packing", sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what one returns is written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
