"""The registered queries of these operators, over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, decontam, jaccard, lines, lm, mix, phrases, quality, shards, trie, urls, variants
from .sql import SQL

__all__ = ["QUERIES", "SQL"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged by rules, then by the models."""
    return urls.judge_urls(_table(spark, sf_dir, "pages"))


def op2_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from the view of each participant; masks as arrays of places."""
    parts = chat.rotate(_table(spark, sf_dir, "conversations"))
    return parts.select(
        "conv_id", "perspective", "part", "n_turns", "rendered",
        F.transform("mask", lambda m: m["start"]).alias("mask_starts"),
        F.transform("mask", lambda m: m["end"]).alias("mask_ends"),
    )


def op3_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the windows of 35 words that come elsewhere."""
    return phrases.with_digest(_table(spark, sf_dir, "documents"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component of five-word Jaccard similarity 0.8."""
    return jaccard.similar_documents(_table(spark, sf_dir, "documents"))


def op5_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability."""
    return lm.score_documents(_table(spark, sf_dir, "documents"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes of it."""
    return mix.mix_sources(_table(spark, sf_dir, "documents")).select(
        "doc_id", "source", "size", "source_size", "target", "taken"
    )


def op7_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard and slot."""
    return shards.assign_shards(_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page without its site's boilerplate lines."""
    return lines.drop_boilerplate(_table(spark, sf_dir, "pages"))


def op9_benchmark_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's overlap with the benchmark."""
    found = decontam.find_overlap(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), spans=False
    )
    ids = F.array_sort("item_ids")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's measures, distances from its language and verdict."""
    return quality.quality(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "char_distance", "word_distance",
    )


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of all rebuilt conversations, with subtree sums."""
    return trie.trie(_table(spark, sf_dir, "conversations"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of seven code points or more seen twice, with its form and root."""
    return variants.variants(_table(spark, sf_dir, "documents"))


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest inner products found for every vector whose id is divisible by 20."""
    return ann.nearest(_table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (
    op1_url_filter, op2_chat_rotation, op3_repeated_phrases, op4_ngram_jaccard, op5_deleted_interpolation,
    op6_mix_sources, op7_minimax_shards, op8_site_lines, op9_benchmark_overlap, op10_quality_rules,
    op11_conversation_trie, op12_spelling_variants, op13_nearest_neighbours,
)}
