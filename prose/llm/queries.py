"""Queries of the training-data operators: each runs its operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, jaccard, middle, packing, pages, periods, pii, pitman_yor, quality, repeats, tokens, vectors
from .oracle import ORACLE
from .support import documents


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    tokenizer = tokenizer_path("byte_bpe_50k.json")
    nodes, last = chat.format_tree(rows.unionByName(extra), tokenizer)
    return chat.read_back(nodes, last, tokenizer)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(documents(spark, sf_dir)))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json")))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_components(documents(spark, sf_dir))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score_held_out(documents(spark, sf_dir))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = middle.transform(documents(spark, sf_dir))
    text = middle.restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.digest(periods.periodic_runs(periods.planted(documents(spark, sf_dir))))


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_chat_formatting,
        op2_substring_dedup,
        op3_quality_rules,
        op4_benchmark_decontamination,
        op5_pii,
        op6_best_fit_packing,
        op7_jaccard_join,
        op8_token_counts,
        op9_html_extraction,
        op10_lm_scoring,
        op11_fill_in_middle,
        op12_periodic_runs,
        op13_embedding_dedup,
    )
}
__all__ = ["ORACLE", "QUERIES"]
