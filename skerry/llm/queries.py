"""Queries of this subpackage, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table
from . import automaton, decontaminate, importance, language, middle, pieces, prefix_tree, quantise, shards, simhash, spelling, suffix_array, toxicity


def tokenizer_path() -> str:
    """The piece model's file, where the public tokenizers are installed."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text", "rest")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predict(table(spark, sf_dir, "documents"))


def op4_noisy_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predict(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_texts(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_additive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantise.search(table(spark, sf_dir, "embeddings"))


def op7_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.find_windows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op8_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array.remove_repeats(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard(table(spark, sf_dir, "documents"))


def op10_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return automaton.remove_repeats(table(spark, sf_dir, "documents"))


def op11_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_tree.join(table(spark, sf_dir, "documents"))


def op12_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return middle.transform(table(spark, sf_dir, "documents"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_importance": op1_importance, "op2_simhash": op2_simhash, "op3_language": op3_language, "op4_noisy_channel": op4_noisy_channel, "op5_pieces": op5_pieces, "op6_additive": op6_additive, "op7_prefix_join": op7_prefix_join, "op8_suffix_array": op8_suffix_array, "op9_sharding": op9_sharding, "op10_automaton": op10_automaton, "op11_prefix_tree": op11_prefix_tree, "op12_middle": op12_middle, "op13_spelling": op13_spelling}
#: The others can't be stated in DuckDB's SQL (no XXH64, no crc32, no piece model), or not so that it ends on whole tables.
ORACLES: dict[str, str] = {"op12_middle": middle.SQL}
