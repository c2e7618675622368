"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from refrain.llm import ann, decontaminate, hilbert, near_dup, packing, pii, tokenfile, toxicity, trie_count, url_filter
from refrain.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.classify(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op2_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op3_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.shard(table(spark, sf_dir, "documents"))


def op4_bounded_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.round_trip(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op6_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_count.count(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op7_pruned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op8_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.match(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_pii_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op10_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.components(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_counterfactual_toxicity,
        op2_url_trees,
        op3_hilbert_shards,
        op4_bounded_best_fit,
        op5_token_files,
        op6_trie_token_counts,
        op7_pruned_graph,
        op8_positional_index,
        op9_pii_field,
        op10_hyperminhash,
    )
}
#: Models, sketches, binary files and the tokenizer have no SQL form; tests hold these queries against brute force.
ORACLES: dict[str, str] = {}
