"""Answering a table of questions from an index."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import stamp
from ..operators.embedding import embedding, pack
from ..operators.knn import nearest
from ..operators.results import (
    file_path, packed_context, search_result, source_listing, sources_per_query, with_packs,
)
from ..session import broadcast_if_small, cut_lineage
from ..settings import ERROR_PREFIX, MAX_TOKENS, NO_INDEX_MESSAGE, SYSTEM_PROMPT
from .index import Index

# Ids looked up by value, so that storage can skip what holds none of them.
_MOST_IDS = 10_000
# Hits without texts that may be broadcast (about 100 MB).
_MOST_BROADCAST = 500_000

# prompts (query_id, pack_no, system, query, context) -> one text per row
Generator = Callable[[pd.DataFrame], list[str]]


def search(index: Index, questions: DataFrame, k: int | None = None) -> DataFrame:
    """query_id, rank, chunk_id, distance for questions (query_id, query)."""
    return _nearest(index, _embedded(index, questions, "raise"), k)


def _embedded(index: Index, questions: DataFrame, on_error: str) -> DataFrame:
    vector = embedding("query", index.embedder, on_error)
    return questions.select("query_id", "query", pack(vector).alias("packed"))


def _nearest(index: Index, asked: DataFrame, k: int | None) -> DataFrame:
    return nearest(
        asked.select("query_id", "packed"), index.packed, k or index.settings.top_k, vector_id="chunk_id",
        query_vector="packed", vector="packed",
    )


def with_rows(hits: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """hits joined with the rows of a stored table they point to.

    Few hits: their ids go into the scan as a filter (a bloom filter on the key lets it
    skip nearly everything) and the hits are broadcast.  More hits are only broadcast,
    and beyond a limit it is a plain join.
    """
    ids = hits.select(key).distinct().limit(_MOST_IDS + 1).collect()
    if len(ids) <= _MOST_IDS:
        table = table.filter(F.col(key).isin([r[0] for r in ids]))
    return table.join(broadcast_if_small(hits, _MOST_BROADCAST), key)


def similar(index: Index, snippets: DataFrame, k: int | None = None) -> DataFrame:
    """The chunks nearest to each snippet with the documents they come from.

    query_id, rank, chunk_id, start_line, end_line, result (document, score).  The score
    is the index's squared distance: never negative, smaller is closer.
    """
    hits = cut_lineage(search(index, snippets, k))
    chunks = index.chunks.select("chunk_id", "doc_id", "start_line", "end_line")
    located = cut_lineage(with_rows(hits, chunks, "chunk_id"))
    documents = index.documents.select("doc_id", "content", "metadata")
    return with_rows(located, documents, "doc_id").select(
        "query_id", "rank", "chunk_id", "start_line", "end_line",
        search_result(F.col("content"), F.col("metadata"), F.col("distance")).alias("result"),
    )


def context_hits(index: Index, questions: DataFrame, k: int | None = None) -> DataFrame:
    """Ranked chunks with their texts: query_id, rank, chunk_id, distance, content, …"""
    return _with_texts(index, search(index, questions, k))


def _with_texts(index: Index, hits: DataFrame) -> DataFrame:
    hits = cut_lineage(hits)
    chunks = index.chunks.select(
        "chunk_id", "doc_id", "start_line", "end_line", "content", "metadata"
    )
    return with_rows(hits, chunks, "chunk_id")


def ask(
    index: Index | None,
    questions: DataFrame,
    k: int | None = None,
    generator: Generator | None = None,
    show_sources: bool = False,
    budget: int = MAX_TOKENS,
) -> DataFrame:
    """One row per question (query_id, query), also for those that cannot be answered.

    A question that is empty, that the embedder fails on, or one of whose prompts the
    generator fails on has the status 'error' and says why; others are answered all the same.
    query_id, query, status, response, sources, confidence, timestamp, metadata.  Without
    a generator the response is the packed context.
    """
    now = F.current_timestamp()
    asked = questions.select("query_id", "query")
    if index is None:
        return _result(asked.withColumn("status", F.lit("no_index")), NO_INDEX_MESSAGE, now)
    blank = F.coalesce(F.trim("query"), F.lit("")) == ""
    bad = asked.filter(blank).withColumn("status", F.lit("error"))
    embedded = cut_lineage(_embedded(index, asked.filter(~blank), "null"))
    lost = embedded.filter("packed is null").select("query_id", "query", F.lit("error").alias("status"))
    embedded = embedded.filter("packed is not null")
    good = embedded.select("query_id", "query")
    hits = cut_lineage(_with_texts(index, _nearest(index, embedded, k)))
    packs = with_packs(hits, budget)
    answers = _answers(packs, good, generator, budget)
    found = sources_per_query(
        hits.select("query_id", "rank", "distance", "content", "metadata")
    ).select(
        "query_id",
        F.transform(
            "hits", lambda h: search_result(h["content"], h["metadata"], h["distance"])
        ).alias("sources"),
        source_listing(
            F.transform("hits", lambda h: file_path(h["metadata"])), show_sources
        ).alias("_listing"),
    )
    failed = F.col("error").isNotNull()
    none = F.array().cast(_SOURCES)
    done = (
        good.join(answers, "query_id", "left").join(found, "query_id", "left")
        .select(
            "query_id", "query", F.when(failed, "error").otherwise("ok").alias("status"),
            F.when(failed, F.concat(F.lit(ERROR_PREFIX), "error"))
            .otherwise(F.concat(F.coalesce("response", F.lit("")), F.coalesce("_listing", F.lit(""))))
            .alias("response"),
            F.when(failed, none).otherwise(F.coalesce("sources", none)).alias("sources"),
            F.lit(0.0).alias("confidence"), now.alias("timestamp"),
            F.create_map(F.lit("timestamp"), stamp(now)).alias("metadata"),
        )
    )
    return done.unionByName(_result(bad, f"{ERROR_PREFIX}empty query", now)).unionByName(
        _result(lost, f"{ERROR_PREFIX}the query could not be embedded", now)
    )


_SOURCES = (
    "array<struct<document:struct<content:string,metadata:map<string,string>>,score:double>>"
)


def _result(rows: DataFrame, message: str, now) -> DataFrame:
    return rows.select(
        "query_id", "query", "status", F.lit(message).alias("response"),
        F.array().cast(_SOURCES).alias("sources"), F.lit(0.0).alias("confidence"),
        now.alias("timestamp"),
        F.create_map(F.lit("timestamp"), stamp(now)).alias("metadata"),
    )


def prompts(packs: DataFrame, questions: DataFrame) -> DataFrame:
    """One prompt per pack: query_id, pack_no, system, query, context."""
    return packed_context(packs).join(questions, "query_id").select(
        "query_id", "pack_no", F.lit(SYSTEM_PROMPT).alias("system"), "query", "context"
    )


def _answers(
    packs: DataFrame, questions: DataFrame, generator: Generator | None, budget: int
) -> DataFrame:
    """query_id, response, error (why there is no response)."""
    if generator is None:
        return (
            packed_context(packs)
            .groupBy("query_id")
            .agg(F.sort_array(F.collect_list(F.struct("pack_no", "context"))).alias("_c"))
            .select(
                "query_id", F.array_join(F.col("_c.context"), "\n\n").alias("response"),
                F.lit(None).cast("string").alias("error"),
            )
        )

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            said = _said(generator, batch)
            yield pd.DataFrame(
                {
                    "query_id": batch["query_id"],
                    "rank": batch["pack_no"],
                    "content": pd.Series([s for s, _ in said], index=batch.index, dtype=object),
                    "error": pd.Series([e for _, e in said], index=batch.index, dtype=object),
                }
            )

    kind = questions.schema["query_id"].dataType.simpleString()
    done: DataFrame | None = None
    while True:
        texts = cut_lineage(
            prompts(packs, questions).mapInPandas(
                write, f"query_id {kind}, rank int, content string, error string"
            )
        )
        # One text for a query is its answer, an error ends it; more texts are packed, at
        # least two to a pack so that they get fewer, and summarised again.
        state = texts.groupBy("query_id").agg(
            F.max("rank").alias("_last"), F.max("content").alias("response"), F.min("error").alias("error")
        )
        open_ = (F.col("_last") > 0) & F.col("error").isNull()
        ended = state.filter(~open_).drop("_last")
        done = ended if done is None else done.unionByName(ended)
        several = cut_lineage(state.filter(open_).select("query_id"))
        if several.isEmpty():
            return done
        packs = with_packs(texts.join(several, "query_id", "left_semi").drop("error"), budget, least=2)


def _said(generator: Generator, batch: pd.DataFrame) -> list[tuple[str | None, str | None]]:
    """(text, error) of every prompt; where a batch fails, its prompts are tried one by one."""
    try:
        texts = list(generator(batch))
        if len(texts) != len(batch):
            raise ValueError(f"{len(texts)} texts for {len(batch)} prompts")
        return [(text, None) for text in texts]
    except Exception as e:
        if len(batch) == 1:
            return [(None, str(e) or type(e).__name__)]
    return [_said(generator, batch.iloc[i:i + 1])[0] for i in range(len(batch))]


def answered(results: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """What the history keeps of results: also failures, with their message."""
    return results.select(conv_id, "query", "response")
