"""Shaping neighbours into results: sources, listings, packs of context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import n_tokens
from ..settings import MAX_TOKENS, SOURCES_HEADER, UNKNOWN_PATH


def file_path(metadata: Column | str) -> Column:
    """The path in a metadata map, or 'Unknown'."""
    metadata = F.col(metadata) if isinstance(metadata, str) else metadata
    return F.coalesce(F.try_element_at(metadata, F.lit("file_path")), F.lit(UNKNOWN_PATH))


def search_result(content: Column, metadata: Column, score: Column) -> Column:
    """A document and its score; a missing score counts as 0."""
    return F.struct(
        F.struct(content.alias("content"), metadata.alias("metadata")).alias("document"),
        F.coalesce(score, F.lit(0.0)).alias("score"),
    )


def sources_per_query(hits: DataFrame) -> DataFrame:
    """One row per query with its ranked hits in `hits` (at most k, so bounded).

    hits: query_id, rank and any other columns.
    """
    others = [c for c in hits.columns if c not in ("query_id", "rank")]
    found = F.collect_list(F.struct("rank", *others))
    # By rank alone: maps, as metadata has them, have no order.
    by_rank = F.array_sort(found, lambda a, b: a["rank"] - b["rank"])
    return hits.groupBy("query_id").agg(by_rank.alias("hits"))


def source_listing(paths: Column, show: Column | bool = True) -> Column:
    """The numbered list shown below an answer; '' where sources are not shown."""
    show = F.lit(show) if isinstance(show, bool) else show
    lines = F.transform(
        paths, lambda p, i: F.concat(F.lit("\n"), (i + 1).cast("string"), F.lit(". "), p)
    )
    return F.when(show, F.concat(F.lit(SOURCES_HEADER), F.array_join(lines, ""))).otherwise("")


def with_packs(
    hits: DataFrame, budget: int = MAX_TOKENS, text: str = "content", least: int = 1
) -> DataFrame:
    """pack_no of every hit: consecutive ranks share a pack while it holds <= budget.

    A text above the budget has a pack of its own, but a pack takes `least` texts (the last
    one what is left) whatever they hold.  The greedy walk goes over the few
    hits of one query, inside one row.
    """
    rows = sources_per_query(hits.withColumn("_tokens", n_tokens(text)))
    start = F.struct(
        F.lit(-1).alias("pack"), F.lit(0).alias("used"), F.lit(0).alias("held"),
        F.array().cast("array<int>").alias("packs"),
    )

    def step(acc: Column, n: Column) -> Column:
        fits = (acc["pack"] >= 0) & ((acc["used"] + n <= budget) | (acc["held"] < least))
        pack = F.when(fits, acc["pack"]).otherwise(acc["pack"] + 1)
        return F.struct(
            pack.alias("pack"),
            F.when(fits, acc["used"] + n).otherwise(n).alias("used"),
            F.when(fits, acc["held"] + 1).otherwise(1).alias("held"),
            F.concat(acc["packs"], F.array(pack)).alias("packs"),
        )

    packs = F.aggregate(F.col("hits._tokens"), start, step, lambda acc: acc["packs"])
    return (
        rows.withColumn("_zip", F.arrays_zip(F.col("hits"), packs.alias("pack_no")))
        .select("query_id", F.explode_outer("_zip").alias("_z"))
        .select("query_id", "_z.hits.*", F.col("_z.pack_no"))
        .withColumnRenamed("_tokens", "n_tokens")
    )


def packed_context(packs: DataFrame, text: str = "content") -> DataFrame:
    """query_id, pack_no, context: the texts of a pack in the order of their ranks."""
    return (
        packs.groupBy("query_id", "pack_no")
        .agg(
            F.sort_array(F.collect_list(F.struct("rank", text))).alias("_texts"),
            F.sum("n_tokens").alias("n_tokens"),
        )
        .select(
            "query_id", "pack_no", "n_tokens",
            F.array_join(F.col(f"_texts.{text}"), "\n\n").alias("context"),
        )
    )
