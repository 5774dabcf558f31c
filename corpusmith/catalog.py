"""The registered queries: every operator on the given tables, whole tables only."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import vectors as V
from .functions.language import language_label
from .functions.mime import with_mime_type
from .functions.paths import base_name, parent, relative, suffix
from .operators import bundle, corpus, history, ignore, pairs
from .operators.chunking import chunk_lines, chunk_windows, line_numbers, with_links
from .operators.embedding import hash_embedder, with_embedding
from .operators.knn import nearest, nearest_to_one
from .operators.results import file_path, sources_per_query, source_listing, with_packs
from .plans import ask as A
from .plans import index as I
from .session import broadcast_if_small, cut_lineage, new_folder, spread
from .settings import WEB_CHUNK_OVERLAP, WEB_CHUNK_SIZE, Settings
from .sources import filetree

Query = Callable[[SparkSession, str], DataFrame]

DIM = 64
ROOT = "/corpus"
PACK_BUDGET = 1500
PART_BYTES = 65536
SMALL = Settings(chunk_size=512, chunk_overlap=64, dim=DIM)
EXTENSIONS = {"en": ".py", "fr": ".js", "de": ".java", "es": ".md"}
IGNORE = ["*.md", "src1/", "src2/*/1*", "src[34]/fr/*", "!src5/en", "src6/d?/*", "src7/e[!s]"]
INCLUDED = [".py", ".js", ".java", ".cpp", ".h"]
EXCLUDED = ["src8", "*7.py", ".git", "node_modules"]
MAX_SIZE = 20000
PAIR_COSINE = 0.4
# Labels whose first vectors may be broadcast (about 30 MB).
MOST_LABELS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, content of all documents, spread for work per row."""
    docs = table(spark, sf_dir, "documents")
    return spread(docs.select("doc_id", F.col("text").alias("content")), "doc_id")


def as_files(docs: DataFrame) -> DataFrame:
    """Documents as files of a tree: source/lang/doc_id with an ending per language.

    The size is in characters, which the table holds: no text is read for it."""
    ending = F.lit("")
    for lang, ext in EXTENSIONS.items():
        ending = F.when(F.col("lang") == lang, ext).otherwise(ending)
    rel = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), ending))
    return docs.select(
        "doc_id", "lang", "source", F.concat(F.lit(ROOT + "/"), rel).alias("path"),
        rel.alias("rel_path"), F.col("n_chars").alias("size"),
        F.col("text").alias("content"),
    ).select(
        "doc_id", "lang", "source", "path", relative("path", ROOT).alias("rel_path"),
        parent("rel_path").alias("dir"), base_name("rel_path").alias("name"),
        suffix(base_name("rel_path")).alias("ext"), "size", "content",
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_files(table(spark, sf_dir, "documents"))


def with_metadata(docs: DataFrame) -> DataFrame:
    """The document table an index is built from."""
    return as_files(docs).select(
        F.col("doc_id").cast("string").alias("doc_id"), "content",
        F.create_map(F.lit("file_path"), F.col("path"), F.lit("lang"), F.col("lang"))
        .alias("metadata"),
    )


def index_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(with_metadata(table(spark, sf_dir, "documents")), "doc_id")


_built: dict[tuple[str, str], str] = {}


def corpus_index(spark: SparkSession, sf_dir: str) -> I.Index:
    """The index of all documents, built once per application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    embedder = hash_embedder(DIM)
    if key in _built:
        try:
            return I.load_index(spark, _built[key], embedder)
        except FileNotFoundError:  # the shared folder was emptied meanwhile
            pass
    _built[key] = new_folder(spark, "index")
    return I.build_index(index_input(spark, sf_dir), _built[key], SMALL, embedder)


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query")
    )


# --- vectors -----------------------------------------------------------------


def _all_pairs(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return nearest(e.withColumnRenamed("vec_id", "query_id"), e, 5, method)


def knn_l2_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's five nearest, itself first: squared distance, then id."""
    return _all_pairs(spark, sf_dir, "l2")


def _similarity(method: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _all_pairs(spark, sf_dir, method)

    return run


def pair_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All measures between each vector and the first vector of its label."""
    e = table(spark, sf_dir, "embeddings")
    # The first vector of each label in one aggregate, combined before the shuffle.
    first = cut_lineage(e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("other")))
    pair = e.join(broadcast_if_small(first, MOST_LABELS), "label")
    return pair.select(
        "vec_id",
        *(F.round(V.similarity("embedding", "other", m), 6).alias(m) for m in V.METHODS),
        F.round(V.squared_l2("embedding", "other"), 6).alias("squared_l2"),
    )


def similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of vectors with a cosine of 0.4 or more, each pair once, by pivot rings."""
    found = pairs.similar_pairs(table(spark, sf_dir, "embeddings"), threshold=PAIR_COSINE, method="cosine")
    return found.select("left_id", "right_id", F.round("score", 6).alias("score"))


def normalize_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return e.withColumn("u", V.normalize("embedding")).select(
        "vec_id", F.round(V.norm("embedding"), 6).alias("norm"),
        F.round(V.norm("u"), 6).alias("unit_norm"),
        F.round(F.element_at("u", 1), 6).alias("first"),
        F.size("u").cast("long").alias("dim"),
    )


def knn_single_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten vectors nearest to one given vector (that of the smallest id)."""
    e = table(spark, sf_dir, "embeddings")
    given = e.agg(F.min_by("embedding", "vec_id").alias("v")).first()["v"]
    return nearest_to_one(e, given, 10)


def vector_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").agg(
        F.count("*").alias("n_vectors"),
        F.min(F.size("embedding")).cast("long").alias("min_dim"),
        F.max(F.size("embedding")).cast("long").alias("max_dim"),
    )


# --- chunks and embeddings -----------------------------------------------------


def chunk_lines_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_lines(texts(spark, sf_dir), 60, 15).select(
        "doc_id", "chunk_no", "start_line", "end_line", "n_tokens",
        F.md5("content").alias("content_md5"),
    )


def chunk_windows_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_windows(texts(spark, sf_dir), 64, 16).select(
        "doc_id", "chunk_no", F.md5("content").alias("content_md5")
    )


def chunk_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The web preset: smaller chunks that know their neighbours."""
    chunks = chunk_lines(texts(spark, sf_dir), WEB_CHUNK_SIZE, WEB_CHUNK_OVERLAP)
    return with_links(chunks).select("doc_id", "chunk_no", "chunk_id", "prev_id", "next_id")


def line_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_numbers(texts(spark, sf_dir)).select(
        "doc_id", "line_no", "n_tokens", "running_tokens"
    )


def hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The built-in embedder's vectors, one row per entry that is not zero."""
    vectors = with_embedding(texts(spark, sf_dir), hash_embedder(DIM))
    # The outer kind: a plain one adds a filter that would run the embedder twice.
    return (
        vectors.select("doc_id", F.posexplode_outer("embedding").alias("pos", "value"))
        .filter("value <> 0")
        .withColumn("value", F.round(F.col("value").cast("double"), 6))
    )


# --- search ---------------------------------------------------------------------


def similar_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents nearest to each question, without an index."""
    embedder = hash_embedder(DIM)
    asked = with_embedding(questions(spark, sf_dir), embedder, "query")
    docs = with_embedding(texts(spark, sf_dir), embedder)
    return nearest(asked, docs, 5, vector_id="doc_id")


def similar_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest chunks of each snippet with the documents they belong to."""
    found = A.similar(corpus_index(spark, sf_dir), questions(spark, sf_dir), 5)
    return found.select(
        "query_id", "rank", "chunk_id", "start_line", "end_line",
        F.md5("result.document.content").alias("document_md5"),
        "result.score",
    )


def _context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_lineage(A.context_hits(corpus_index(spark, sf_dir), questions(spark, sf_dir), 5))


def ask_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranked sources of every question as one text."""
    hits = sources_per_query(_context(spark, sf_dir).select("query_id", "rank", "chunk_id"))
    return hits.select(
        "query_id", F.array_join(F.col("hits.chunk_id"), " ").alias("sources"),
        F.size("hits").cast("long").alias("n_sources"),
    )


def ask_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete answers: packed context and the listing of source files."""
    index = corpus_index(spark, sf_dir)
    done = A.ask(index, questions(spark, sf_dir), 5, show_sources=True, budget=PACK_BUDGET)
    return done.select(
        "query_id", "status", F.md5("response").alias("response_md5"),
        F.size("sources").cast("long").alias("n_sources"), "confidence",
    )


def context_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_packs(_context(spark, sf_dir), PACK_BUDGET).select(
        "query_id", "rank", "pack_no", F.col("n_tokens").cast("long").alias("n_tokens")
    )


def digest(batch) -> list[str]:
    """Stands in for a language model: one word that depends on all of the context."""
    return [hashlib.md5(c.encode()).hexdigest() for c in batch["context"]]


def summary_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs are summarised, their summaries packed again, until one text is left."""
    done = A.ask(
        corpus_index(spark, sf_dir), questions(spark, sf_dir), 5, digest, budget=PACK_BUDGET
    )
    return done.select("query_id", "response")


def refusing(batch) -> list[str]:
    """`digest`, but a question of an odd number of characters is an error."""
    for query_id, query in zip(batch["query_id"], batch["query"]):
        if len(query) % 2:
            raise ValueError(f"refused {query_id}")
    return digest(batch)


def ask_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions that the generator refuses are rows with their error; the others are answered."""
    done = A.ask(
        corpus_index(spark, sf_dir), questions(spark, sf_dir), 5, refusing, budget=PACK_BUDGET
    )
    return done.select("query_id", "status", "response")


def source_listing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _context(spark, sf_dir).select("query_id", "rank", file_path("metadata").alias("p"))
    return sources_per_query(hits).select(
        "query_id", source_listing(F.col("hits.p")).alias("listing")
    )


# --- index ----------------------------------------------------------------------


def _stored(index: I.Index) -> DataFrame:
    """Chunks with a check value of their vectors."""
    entry = F.transform("embedding", lambda v, i: v.cast("double") * (i + 1))
    return index.stored().select(
        "chunk_id", "doc_id", "chunk_no", "start_line", "end_line",
        F.md5("content").alias("content_md5"),
        F.element_at("metadata", "lang").alias("lang"),
        F.round(F.aggregate(entry, F.lit(0.0), lambda a, v: a + v), 6).alias("vector_check"),
    )


def save_load_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Build, save elsewhere, load and join vectors to chunks."""
    path = new_folder(spark, "copy")
    I.save_index(corpus_index(spark, sf_dir), path)
    return _stored(I.load_index(spark, path, hash_embedder(DIM)))


def index_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_index(spark, sf_dir).info().select(
        "model_name", "embedding_dimension", "is_initialized", "chunk_size",
        "chunk_overlap", "n_documents", "n_chunks",
    )


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two states of the collection: Spanish texts are new, toxic ones are gone, French
    ones were rewritten in lower case."""
    docs = spread(table(spark, sf_dir, "documents"), "doc_id")
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id")
    old = docs.filter("lang <> 'es'")
    new = docs.join(toxic, "doc_id", "left_anti").withColumn(
        "text", F.when(F.col("lang") == "fr", F.lower("text")).otherwise(F.col("text"))
    ).withColumn("n_chars", F.length("text").cast("long"))
    return old, new


def refresh_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = snapshots(spark, sf_dir)
    sha = lambda d: d.select("doc_id", F.sha2("text", 256).alias("content_sha"))
    return I.refresh_plan(sha(old), sha(new))


def refresh_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of the old state brought to the new one; equal to building it anew."""
    old, new = snapshots(spark, sf_dir)
    path = new_folder(spark, "refresh")
    index = I.build_index(with_metadata(old), path, SMALL, hash_embedder(DIM))
    return _stored(I.refresh_index(index, with_metadata(new)))


def refresh_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three versions: a build of the old state, a delta to a middle one, a delta to the new one.

    The merged read of the last delta and the compacted full version, each with all columns of
    `refresh_index`; both equal an index built anew from the new state.
    """
    old, new = snapshots(spark, sf_dir)
    middle = old.filter(F.col("doc_id") % 7 != 0).withColumn(
        "text", F.when(F.col("lang") == "de", F.upper("text")).otherwise(F.col("text"))
    )
    path = new_folder(spark, "chain")
    index = I.build_index(with_metadata(old), path, SMALL, hash_embedder(DIM))
    index = I.refresh_index(index, with_metadata(middle))
    index = I.refresh_index(I.load_index(spark, path, hash_embedder(DIM)), with_metadata(new))
    merged = _stored(index).withColumn("stage", F.lit("delta"))
    return merged.unionByName(_stored(I.compact(index)).withColumn("stage", F.lit("compacted")))


# --- files ----------------------------------------------------------------------


def corpus_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.profile(files(spark, sf_dir), "lang", "source").select(
        "lang", "source", F.col("grouping").cast("long").alias("grouping"), "n_files", "size"
    )


def chunk_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, chunks and tokens by language and ending, with subtotals."""
    docs = spread(files(spark, sf_dir).select("doc_id", "lang", "ext", "content"), "doc_id")
    chunks = chunk_lines(docs, SMALL.chunk_size, SMALL.chunk_overlap)
    return corpus.chunk_profile(chunks, "lang", "ext").withColumn(
        "grouping", F.col("grouping").cast("long")
    )


def load_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The message after loading the collection."""
    counted = table(spark, sf_dir, "documents").groupBy().agg(F.count("*").alias("n_documents"))
    status, message = corpus.load_status_columns(F.col("n_documents"))
    return counted.select("n_documents", status.alias("status"), message.alias("message"))


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_extract("url", r"^[a-z]+://[^/?#]+([^?#]*)", 1)
    return table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract(path, r"[^/]*$", 0).alias("name")
    )


def file_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = page_paths(spark, sf_dir).select(suffix("name").alias("ext"))
    return corpus.extensions(pages.unionByName(files(spark, sf_dir).select("ext")))


def mime_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = page_paths(spark, sf_dir).select(
        F.concat(F.lit("page"), F.col("page_id")).alias("id"), "name"
    )
    docs = files(spark, sf_dir).select(
        F.concat(F.lit("doc"), F.col("doc_id")).alias("id"), "name"
    )
    return with_mime_type(pages.unionByName(docs)).select("id", "name", "mime")


def language_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(
        F.concat(F.lit("page"), F.col("page_id")).alias("id"), F.col("html").alias("content")
    )
    docs = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc"), F.col("doc_id")).alias("id"), F.col("text").alias("content")
    )
    both = spread(pages, "id").unionByName(spread(docs, "id"))
    return both.select("id", language_label("content").alias("language"))


def ignore_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose own path matches no rule."""
    kept = files(spark, sf_dir).filter(~ignore.matches_rule("rel_path", IGNORE))
    return kept.select("doc_id", "rel_path")


def ignore_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that remain when folders that match a rule go with all they hold."""
    return ignore.drop_ignored(files(spark, sf_dir), IGNORE).select("doc_id", "rel_path")


def project_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = ignore.project_filter(files(spark, sf_dir), INCLUDED, EXCLUDED, MAX_SIZE)
    return kept.select("doc_id", "rel_path", "size")


def files_per_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.files_per_folder(files(spark, sf_dir))


def bundle_by_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text per source, in parts where a source is large."""
    by_source = files(spark, sf_dir).withColumn("dir", F.col("source"))
    return bundle.bundles(by_source, part_bytes=PART_BYTES).select(
        "dir", "part_no", "n_files", F.md5("text").alias("text_md5")
    )


def _write_tree(docs: DataFrame, root: str) -> int:
    """Writes every document as a file below root; returns how many."""

    def write(batches):
        for batch in batches:
            for rel, text in zip(
                batch.column("rel_path").to_pylist(), batch.column("content").to_pylist()
            ):
                bundle.write_text(f"{root}/{rel}", text)
            yield pa.RecordBatch.from_arrays(
                [pa.array([batch.num_rows], pa.int64())], names=["n"]
            )

    written = docs.select("rel_path", "content").mapInArrow(write, "n bigint")
    return written.agg(F.sum("n").alias("n")).first()["n"]


def scan_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as a tree of files, listed and read again."""
    root = new_folder(spark, "tree")
    _write_tree(spread(files(spark, sf_dir), "doc_id"), root)
    return filetree.readable(filetree.scan(spark, root)).select(
        "rel_path", "dir", "name", "ext", "size", F.sha2("content", 256).alias("content_sha")
    )


def tree_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as a tree of files and listed by levels, names and sizes only."""
    root = new_folder(spark, "names")
    _write_tree(spread(files(spark, sf_dir), "doc_id"), root)
    return filetree.list_files(spark, root).select("rel_path", "dir", "name", "ext", "size")


def written_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bundles written as files next to their tree, then read again."""
    root = new_folder(spark, "bundles")
    by_source = files(spark, sf_dir).withColumn("dir", F.col("source"))
    written = bundle.write_bundles(bundle.bundles(by_source, part_bytes=PART_BYTES), root)
    done = cut_lineage(written.select(relative("out_path", root).alias("rel_path"), "n_files"))
    found = filetree.scan(spark, root).select(
        "rel_path", F.md5("content").alias("text_md5")
    )
    return found.join(done, "rel_path").select("rel_path", "n_files", "text_md5")


# --- conversations ----------------------------------------------------------------


def history_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark text asked, before there is an index, in the conversation of the
    same number; question and answer follow its last turn."""
    told = A.ask(None, questions(spark, sf_dir))
    answers = A.answered(told.withColumn("conv_id", F.col("query_id"))).withColumn(
        "ask_no", F.lit(0)
    )
    return history.append_answers(table(spark, sf_dir, "conversations"), answers)


def history_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All user turns asked again, in order, each answered by its own text."""
    talk = table(spark, sf_dir, "conversations")
    again = talk.filter("role = 'user'").select(
        "conv_id", F.col("turn").alias("ask_no"), F.col("text").alias("query"),
        F.col("text").alias("response"),
    )
    return history.append_answers(talk, again, width=4)


def history_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with a system turn are cleared."""
    talk = table(spark, sf_dir, "conversations")
    return history.clear(talk, talk.filter("role = 'system'").select("conv_id"))


QUERIES: dict[str, Query] = {
    "knn_l2_top5": knn_l2_top5,
    "similarity_cosine": _similarity("cosine"),
    "similarity_dot": _similarity("dot"),
    "similarity_euclidean": _similarity("euclidean"),
    "pair_similarity": pair_similarity,
    "similar_pairs": similar_pairs,
    "normalize_vectors": normalize_vectors,
    "knn_single_query": knn_single_query,
    "vector_info": vector_info,
    "chunk_lines": chunk_lines_query,
    "chunk_windows": chunk_windows_query,
    "chunk_links": chunk_links,
    "line_tokens": line_tokens,
    "hash_embed": hash_embed,
    "similar_passages": similar_passages,
    "similar_code": similar_code,
    "ask_sources": ask_sources,
    "ask_failures": ask_failures,
    "ask_answers": ask_answers,
    "context_pack": context_pack,
    "summary_tree": summary_tree,
    "source_listing": source_listing_query,
    "save_load_roundtrip": save_load_roundtrip,
    "index_manifest": index_manifest,
    "refresh_plan": refresh_plan,
    "refresh_index": refresh_index,
    "refresh_chain": refresh_chain,
    "corpus_profile": corpus_profile,
    "chunk_profile": chunk_profile,
    "load_status": load_status,
    "file_extensions": file_extensions,
    "mime_types": mime_types,
    "language_labels": language_labels,
    "ignore_filter": ignore_filter,
    "ignore_prune": ignore_prune,
    "project_filter": project_filter,
    "files_per_folder": files_per_folder,
    "bundle_by_directory": bundle_by_directory,
    "scan_tree": scan_tree,
    "tree_names": tree_names,
    "written_bundles": written_bundles,
    "history_append": history_append,
    "history_replay": history_replay,
    "history_clear": history_clear,
}
