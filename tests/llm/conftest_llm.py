"""The operators and stages under test, by name."""

from pyspark.sql import functions as F

from footfall.llm import (
    chunk_fingerprints,
    fill_in_middle,
    license_join,
    minhash_dedup,
    packing,
    prefix_tokens,
    quality_gbt,
    quality_rules,
    source_mix,
    suffix_dedup,
    suffix_search,
    toxic_passages,
)
from footfall.llm.common import tokenizer_file

PIECES, WORDS = tokenizer_file("piece_bpe_32k.model"), tokenizer_file("word_bpe_49k.json")


def items_of(docs):
    """Test items made of documents: whole texts, short ones, none, and ids that repeat or lack."""
    return docs.select(F.when(F.col("doc_id") != 7, F.col("doc_id") % 8).alias("item_id"), F.substring("text", 5, 300).alias("text"))


OPERATORS = {
    "fingerprints": lambda docs, labels: chunk_fingerprints.fingerprints(docs),
    "tokens": lambda docs, labels: prefix_tokens.count(docs, PIECES),
    "repeats": lambda docs, labels: suffix_dedup.dedup(docs),
    "near_duplicates": lambda docs, labels: minhash_dedup.group(docs),
    "mix": lambda docs, labels: source_mix.plan(docs),
    "toxicity": toxic_passages.classify,
    "packing": lambda docs, labels: packing.pack_texts(docs, WORDS),
    "rules": lambda docs, labels: quality_rules.judge(docs),
    "quality": quality_gbt.classify,
    "licenses": lambda docs, labels: license_join.scan(docs),
    "fill_in_middle": lambda docs, labels: fill_in_middle.transform(docs),
    "decontamination": lambda docs, labels: suffix_search.scan(docs, items_of(docs)),
}
STAGES = {
    "quality": quality_gbt.keep_good,
    "near_duplicates": lambda docs, labels: minhash_dedup.keep_one(docs),
    "repeats": lambda docs, labels: suffix_dedup.without_repeats(docs),
    "mix": lambda docs, labels: source_mix.mixed(docs),
    "decontamination": lambda docs, labels: suffix_search.clean(docs, items_of(docs.where("doc_id = 5"))),
}
