"""The stored index: documents, chunks and vectors as parquet, and a manifest.

Every build or refresh writes a new version folder and then one manifest row; readers
follow the newest row, so a build that dies leaves the old version in use.  Each table
is read back from storage before the next step: nothing upstream is computed twice,
and an executor lost later costs no recomputation of it.

A build or a compaction writes a full version.  A refresh writes a delta on top of the version
it starts from: the rows of added and changed documents and tombstones of the changed and
removed ones, so what it writes grows with the change, not with the collection.  Readers merge
on read: the layers from the last full version up, where a row lives unless a tombstone of its
document lies in a later layer (newest wins).  `compact` writes the merged tables as a full
version again.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunking import chunk_lines, with_links
from ..operators.embedding import Embedder, embedding, hash_embedder, pack, unpack
from ..session import broadcast_if_small
from ..settings import Settings

log = logging.getLogger(__name__)

DOCUMENTS = "doc_id string, content string, metadata map<string,string>, content_sha string"
CHUNKS = (
    "chunk_id string, doc_id string, chunk_no int, n_chunks int, start_line int, "
    "end_line int, n_tokens bigint, prev_id string, next_id string, content string, "
    "metadata map<string,string>"
)
VECTORS = "chunk_id string, doc_id string, packed binary"
MANIFEST = (
    "version int, model_name string, device string, embedding_dimension int, "
    "batch_size int, is_initialized boolean, chunk_size int, chunk_overlap int, "
    "n_documents bigint, n_chunks bigint, kind string, parent_version int"
)
TOMBSTONES = "doc_id string"
# Ids of tombstones broadcast to the readers of a delta, by their total bytes.
_MOST_TOMBSTONE_BYTES = 64 << 20
# Document ids that may be broadcast (about 100 MB).
_MOST_BROADCAST = 1_000_000
_BLOOM = "parquet.bloom.filter.enabled#"


@dataclass(frozen=True)
class Index:
    """Where one version of an index lies, and the embedder queries must use."""

    spark: SparkSession
    path: str
    version: int
    settings: Settings
    embedder: Embedder
    #: Versions merged on read, the full one first; empty for a full version alone.
    layers: tuple[int, ...] = ()

    def table(self, name: str) -> DataFrame:
        schema = {"documents": DOCUMENTS, "chunks": CHUNKS, "vectors": VECTORS}[name]
        layers = self.layers or (self.version,)
        read = lambda v: self.spark.read.schema(schema).parquet(_folder(self.path, v, name))
        if len(layers) == 1:
            return read(layers[0])
        rows = None
        for i, v in enumerate(layers):
            part = read(v).withColumn("_layer", F.lit(i))
            rows = part if rows is None else rows.unionByName(part)
        tombs = None
        for i, v in enumerate(layers[1:], 1):
            part = self.spark.read.schema(TOMBSTONES).parquet(_folder(self.path, v, "tombstones")).withColumn("_dead", F.lit(i))
            tombs = part if tombs is None else tombs.unionByName(part)
        tombs = tombs.groupBy("doc_id").agg(F.max("_dead").alias("_dead"))
        size = tombs.agg(F.sum(F.length("doc_id") + 8)).first()[0] or 0
        if size <= _MOST_TOMBSTONE_BYTES:
            tombs = F.broadcast(tombs)
        live = F.col("_dead").isNull() | (F.col("_dead") <= F.col("_layer"))
        return rows.join(tombs, "doc_id", "left").filter(live).select(*[c.split()[0] for c in schema.split(", ")])

    @property
    def documents(self) -> DataFrame:
        return self.table("documents")

    @property
    def chunks(self) -> DataFrame:
        return self.table("chunks")

    @property
    def packed(self) -> DataFrame:
        """chunk_id, doc_id and the vector as it is stored."""
        return self.table("vectors")

    @property
    def vectors(self) -> DataFrame:
        return self.packed.select("chunk_id", "doc_id", unpack("packed").alias("embedding"))

    def info(self) -> DataFrame:
        """Model and size of this version, one row."""
        return _manifest(self.spark, self.path).filter(F.col("version") == self.version)

    def stored(self) -> DataFrame:
        """Vectors with the chunks they belong to."""
        return self.vectors.select("chunk_id", "embedding").join(self.chunks, "chunk_id")


def _folder(path: str, version: int, name: str) -> str:
    return f"{path.rstrip('/')}/version={version:06d}/{name}"


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    # Rows of older stores lie in the folder itself, newer ones in a folder per version.
    return spark.read.schema(MANIFEST).option("recursiveFileLookup", "true").parquet(f"{path.rstrip('/')}/manifest")


def _hadoop(spark: SparkSession, path: str):
    """The Hadoop file system of path and the path as Hadoop sees it."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _claims(spark: SparkSession, path: str) -> list[int]:
    system, folder = _hadoop(spark, f"{path.rstrip('/')}/claims")
    if not system.exists(folder):
        return []
    return [int(f.getPath().getName()) for f in system.listStatus(folder) if f.getPath().getName().isdigit()]


def claim_version(spark: SparkSession, path: str) -> int:
    """A version number nobody else has: claimed by creating a file that must not exist yet.

    Two builds that start together try the same number; the file system lets one create it and
    the other moves on to the next, so neither overwrites the other.
    """
    newest = _newest(spark, path)
    version = max([newest["version"] if newest else 0, *_claims(spark, path)]) + 1
    while True:
        system, claim = _hadoop(spark, f"{path.rstrip('/')}/claims/{version:06d}")
        try:
            system.create(claim, False).close()
            return version
        except Exception as e:  # the JVM's FileAlreadyExistsException, through py4j
            if "FileAlreadyExists" not in str(e) and not system.exists(claim):
                raise
            version += 1


def sweep(spark: SparkSession, path: str, older_than_s: float = 86_400) -> list[int]:
    """Removes version folders that no manifest row names and whose claim is older than the limit.

    Such folders are left by builds that died; returns the versions removed.
    """
    import time

    committed = {r["version"] for r in _manifest(spark, path).select("version").collect()} if _newest(spark, path) else set()
    gone = []
    for version in _claims(spark, path):
        system, claim = _hadoop(spark, f"{path.rstrip('/')}/claims/{version:06d}")
        age = time.time() - system.getFileStatus(claim).getModificationTime() / 1000
        if version not in committed and age > older_than_s:
            folder = _hadoop(spark, f"{path.rstrip('/')}/version={version:06d}")[1]
            system.delete(folder, True)
            system.delete(claim, False)
            gone.append(version)
    return sorted(gone)


def _newest(spark: SparkSession, path: str):
    """The last manifest row, or None where there is no index."""
    try:
        rows = _manifest(spark, path).orderBy(F.desc("version")).limit(1).collect()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    return rows[0] if rows else None


def with_sha(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("string").alias("doc_id"), "content", "metadata",
        F.sha2("content", 256).alias("content_sha"),
    )


def make_chunks(docs: DataFrame, settings: Settings) -> DataFrame:
    """Chunks with ids and links; they inherit their document's metadata."""
    chunks = chunk_lines(
        docs.select("doc_id", "content", "metadata"),
        settings.chunk_size, settings.chunk_overlap,
    )
    return with_links(chunks).select([c.split()[0] for c in CHUNKS.split(", ")])


def make_vectors(chunks: DataFrame, embedder: Embedder, on_error: str = "raise") -> DataFrame:
    vector = embedding("content", embedder, on_error)
    return chunks.select("chunk_id", "doc_id", pack(vector).alias("packed"))


def _write(df: DataFrame, path: str, version: int, name: str, bloom: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    if bloom:
        writer = writer.option(_BLOOM + bloom, "true")
    writer.parquet(_folder(path, version, name))


def _commit(index: Index) -> Index:
    spark, e, s = index.spark, index.embedder, index.settings
    delta = len(index.layers) > 1
    row = (
        index.version, e.name, "spark", e.dim, e.batch_size, True, s.chunk_size,
        s.chunk_overlap, index.documents.count(), index.chunks.count(),
        "delta" if delta else "full", index.layers[-2] if delta else None,
    )
    spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("overwrite").parquet(
        f"{index.path.rstrip('/')}/manifest/v{index.version:06d}"
    )
    return index


def init_store(
    spark: SparkSession, path: str, settings: Settings | None = None,
    embedder: Embedder | None = None,
) -> Index:
    """An empty index where there is none; an existing one is left alone."""
    settings = settings or Settings()
    embedder = embedder or hash_embedder(settings.dim)
    if _newest(spark, path) is not None:
        return load_index(spark, path, embedder)
    for name, schema in (("documents", DOCUMENTS), ("chunks", CHUNKS), ("vectors", VECTORS)):
        empty = spark.createDataFrame([], schema)
        empty.write.mode("ignore").parquet(_folder(path, 0, name))
    return _commit(Index(spark, path, 0, settings, embedder))


def build_index(
    docs: DataFrame, path: str, settings: Settings | None = None,
    embedder: Embedder | None = None, on_error: str = "raise",
) -> Index:
    """Chunks, embeds and stores documents (doc_id, content, metadata)."""
    spark = docs.sparkSession
    settings = settings or Settings()
    embedder = embedder or hash_embedder(settings.dim)
    try:
        index = Index(spark, path, claim_version(spark, path), settings, embedder)
        _write(with_sha(docs), path, index.version, "documents", "doc_id")
        _write(make_chunks(index.documents, settings), path, index.version, "chunks", "chunk_id")
        _write(make_vectors(index.chunks, embedder, on_error), path, index.version, "vectors")
        return _commit(index)
    except Exception as e:
        raise RuntimeError(f"Index creation failed: {e}") from e


def save_index(index: Index | None, path: str) -> None:
    """Copies an index to another place; no index is a warning, not an error."""
    if index is None:
        log.warning("No index to save")
        return
    target = Index(index.spark, path, claim_version(index.spark, path), index.settings, index.embedder)
    _write(index.documents, path, target.version, "documents", "doc_id")
    _write(index.chunks, path, target.version, "chunks", "chunk_id")
    _write(index.packed, path, target.version, "vectors")
    _commit(target)


def load_index(spark: SparkSession, path: str, embedder: Embedder | None = None) -> Index:
    """The newest version; queries will be embedded like its texts were."""
    row = _newest(spark, path)
    if row is None:
        raise FileNotFoundError(f"No index found at {path}")
    dim = row["embedding_dimension"]
    embedder = embedder or hash_embedder(dim)
    if embedder.dim != dim:
        raise ValueError(
            f"Index dimension {dim} does not match expected dimension {embedder.dim}"
        )
    if embedder.name != row["model_name"]:
        raise ValueError(
            f"Index was built with {row['model_name']}, not with {embedder.name}"
        )
    settings = Settings(row["chunk_size"], row["chunk_overlap"], dim=dim)
    return Index(spark, path, row["version"], settings, embedder, _layers(spark, path, row))


def _layers(spark: SparkSession, path: str, row) -> tuple[int, ...]:
    """The versions a delta is merged from, its last full version first."""
    if row["kind"] != "delta":
        return ()
    # One row per version ever committed here.
    parent = {r["version"]: r for r in _manifest(spark, path).select("version", "kind", "parent_version").collect()}
    layers = [row["version"]]
    while parent[layers[-1]]["kind"] == "delta":
        layers.append(parent[layers[-1]]["parent_version"])
    return tuple(reversed(layers))


def refresh_plan(old: DataFrame, new: DataFrame) -> DataFrame:
    """doc_id and state ('added', 'changed', 'removed', 'unchanged').

    old and new: doc_id, content_sha.
    """
    o = old.select("doc_id", F.col("content_sha").alias("_old"))
    n = new.select("doc_id", F.col("content_sha").alias("_new"))
    state = (
        F.when(F.col("_old").isNull(), "added")
        .when(F.col("_new").isNull(), "removed")
        .when(F.col("_old") == F.col("_new"), "unchanged")
        .otherwise("changed")
    )
    return o.join(n, "doc_id", "full_outer").select("doc_id", state.alias("state"))


def refresh_index(index: Index, docs: DataFrame, on_error: str = "raise") -> Index:
    """A delta version that holds exactly `docs`; only added and changed texts are embedded.

    Written: the plan of changes, the rows of added, changed and relabelled documents (metadata
    alone changed; their vectors are copied, not embedded again), their chunks and vectors, and
    tombstones of changed, relabelled and removed ones.  Unchanged documents cost a read of
    their id, digest and metadata, and nothing written.
    """
    spark, path, settings = index.spark, index.path, index.settings
    meta = lambda c: F.to_json(F.array_sort(F.map_entries(F.col(c))))
    try:
        version = claim_version(spark, path)
        new = Index(spark, path, version, settings, index.embedder, (*(index.layers or (index.version,)), version))
        fresh_docs = with_sha(docs)
        old = index.documents.select("doc_id", F.col("content_sha").alias("_old"), meta("metadata").alias("_om"))
        cur = fresh_docs.select("doc_id", F.col("content_sha").alias("_new"), meta("metadata").alias("_nm"))
        state = (
            F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed")
            .when(F.col("_old") != F.col("_new"), "changed")
            .when(~F.col("_om").eqNullSafe(F.col("_nm")), "relabelled").otherwise("unchanged")
        )
        plan = old.join(cur, "doc_id", "full_outer").select("doc_id", state.alias("state")).filter("state <> 'unchanged'")
        _write(plan, path, new.version, "plan")
        plan = spark.read.parquet(_folder(path, new.version, "plan"))
        _write(plan.filter("state <> 'added'").select("doc_id"), path, new.version, "tombstones")
        written = plan.filter(F.col("state").isin("added", "changed", "relabelled")).select("doc_id")
        _write(fresh_docs.join(broadcast_if_small(written, _MOST_BROADCAST), "doc_id", "left_semi"), path, new.version, "documents", "doc_id")
        delta_docs = spark.read.schema(DOCUMENTS).parquet(_folder(path, new.version, "documents"))
        _write(make_chunks(delta_docs, settings), path, new.version, "chunks", "chunk_id")
        delta_chunks = spark.read.schema(CHUNKS).parquet(_folder(path, new.version, "chunks"))
        embed = plan.filter(F.col("state").isin("added", "changed")).select("doc_id")
        relabelled = plan.filter("state = 'relabelled'").select("doc_id")
        made = make_vectors(delta_chunks.join(broadcast_if_small(embed, _MOST_BROADCAST), "doc_id", "left_semi"), new.embedder, on_error)
        copied = index.packed.join(broadcast_if_small(relabelled, _MOST_BROADCAST), "doc_id", "left_semi")
        _write(copied.select("chunk_id", "doc_id", "packed").unionByName(made), path, new.version, "vectors")
        return _commit(new)
    except Exception as e:
        raise RuntimeError(f"Index refresh failed: {e}") from e


def compact(index: Index) -> Index:
    """The merged tables of a delta written as a full version; a full version is returned as it is."""
    if len(index.layers) <= 1:
        return index
    spark = index.spark
    version = claim_version(spark, index.path)
    full = Index(spark, index.path, version, index.settings, index.embedder)
    _write(index.documents, index.path, version, "documents", "doc_id")
    _write(index.chunks, index.path, version, "chunks", "chunk_id")
    _write(index.packed, index.path, version, "vectors")
    return _commit(full)
