"""The package's operators as queries over the given tables, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from footfall.llm import (
    chunk_fingerprints,
    fill_in_middle,
    license_join,
    minhash_dedup,
    oracles,
    packing,
    phrase_mining,
    prefix_tokens,
    quality_gbt,
    quality_rules,
    source_mix,
    suffix_dedup,
    suffix_search,
    toxic_passages,
)
from footfall.llm.common import table, tokenizer_file


def op1_chunk_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op2_prefix_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_tokens.count(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"))


def op4_superminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.group(table(spark, sf_dir, "documents"), 85)


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.plan(table(spark, sf_dir, "documents")).drop("key", "nth")


def op6_toxic_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_passages.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_histogram_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_texts(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op9_quality_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gbt.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_join.scan(table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digests(table(spark, sf_dir, "documents")).drop("n_chunks")


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_mining.collocations(table(spark, sf_dir, "documents")).drop("doc_id")


def op13_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_search.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_chunk_fingerprints, op2_prefix_tokens, op3_suffix_dedup, op4_superminhash_dedup, op5_source_mix, op6_toxic_passages,
        op7_histogram_packing, op8_quality_rules, op9_quality_gbt, op10_license_join, op11_fill_in_middle, op12_phrase_mining,
        op13_suffix_decontamination, pipeline,
    )
}
ORACLES: dict[str, str] = {
    "op11_fill_in_middle": oracles.FILL_IN_MIDDLE,
    "op12_phrase_mining": oracles.COLLOCATIONS,
    "op13_suffix_decontamination": oracles.DECONTAMINATION,
}
