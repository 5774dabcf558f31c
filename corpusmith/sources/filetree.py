"""A tree of files as a table.

Listing and reading are two steps.  `list_files` walks the tree level by level: each level's
folders are a table (the frontier), spread over tasks by hash, and the tasks list them; files
found are appended to the listing table, folders found make the next frontier.  The driver sees
counts only.  Linked folders are followed where their real path has not been listed yet (a
visited table of real paths), so a link back up or a second link to one folder lists nothing
twice.  The listing is written once and read from there by every later step.  Filters on names
and sizes apply before `read_bodies` opens anything.  Between the steps the names are spread by
hash, so a folder that holds most of the files is still read by the whole cluster.  Names
starting with '_' or '.' are listed like all others.

`FileTree`, a Python data source of the same listing whose driver opens the top levels, stays
for readers that want `spark.read.format('filetree')`.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.paths import is_hidden
from ..session import cut_lineage, new_folder

FORMAT = "filetree"
LISTING = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("rel_path", T.StringType(), False),
        T.StructField("dir", T.StringType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("ext", T.StringType(), False),
        T.StructField("size", T.LongType(), False),
    ]
)
# Folders the driver opens before it hands the remaining subtrees to executors.
_TOP_FOLDERS = 1024
_ROWS = 8192
# Bytes of file bodies per target partition and per Arrow batch.
_PARTITION_BYTES = 128 << 20
_BATCH_BYTES = 32 << 20


def open_folder(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a local path or a URI (file, hdfs, s3, …)."""
    path = re.sub("^file:/+", "/", path)
    path = re.sub("^s3[an]://", "s3://", path)
    if "://" in path:
        system, inner = fs.FileSystem.from_uri(path)
        return system, inner.rstrip("/") or "/"
    return fs.LocalFileSystem(), path.rstrip("/") or "/"


def folder_exists(path: str) -> bool:
    system, inner = open_folder(path)
    return system.get_file_info(inner).type == fs.FileType.Directory


def list_files(
    spark: SparkSession,
    root: str,
    recursive: bool = True,
    include_hidden: bool = False,
) -> DataFrame:
    """Names and sizes of the files below root; no file is opened.  Written once, then read."""
    files = list_levels(spark, root, recursive)
    return files if include_hidden else files.filter(~is_hidden("rel_path"))


_FOUND = "kind string, path string, rel_path string, dir string, name string, ext string, size bigint, real string"


def _list_level(base: str, shown: str):
    """Entries of the folders of a frontier: files as listing rows, folders with their real path."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = open_folder(shown or "/")
        local = isinstance(system, fs.LocalFileSystem)
        cut = len(base.rstrip("/")) + 1
        for batch in batches:
            out: list[tuple] = []
            for folder in batch.column("folder").to_pylist():
                for info in system.get_file_info(fs.FileSelector(folder)):
                    rel = info.path[cut:]
                    if info.type == fs.FileType.Directory:
                        real = os.path.realpath(info.path) if local else info.path
                        out.append(("dir", info.path, rel, "", "", "", 0, real))
                    elif info.type == fs.FileType.File:
                        where, _, name = rel.rpartition("/")
                        dot = name.rfind(".")
                        ext = name[dot:] if 0 < dot < len(name) - 1 else ""
                        out.append(("file", f"{shown}/{rel}", rel, where, name, ext, info.size or 0, None))
                    if len(out) >= _ROWS:
                        yield _found_batch(out)
                        out = []
            if out:
                yield _found_batch(out)

    return rows


def _found_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string()] * 6 + [pa.int64(), pa.string()]
    names = [f.split()[0] for f in _FOUND.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def list_levels(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """All files below root (hidden ones too), by frontier tables; the listing as written."""
    system, base = open_folder(root)
    shown = root.rstrip("/")
    local = isinstance(system, fs.LocalFileSystem)
    out = new_folder(spark, "listing")
    spark.createDataFrame([], LISTING).write.parquet(out)
    start = os.path.realpath(base) if local else base
    frontier = spark.createDataFrame([(base, start)], "folder string, real string")
    visited = frontier.select("real")
    while True:
        spread = frontier.repartition("folder")
        found = cut_lineage(spread.mapInArrow(_list_level(base, shown), _FOUND))
        found.filter("kind = 'file'").select(*LISTING.names).write.mode("append").parquet(out)
        if not recursive:
            break
        # One path per real folder, and none already listed.
        folders = found.filter("kind = 'dir'").groupBy("real").agg(F.min("path").alias("folder"))
        frontier = cut_lineage(folders.join(visited, "real", "left_anti").select("folder", "real"))
        if frontier.isEmpty():
            break
        visited = cut_lineage(visited.unionByName(frontier.select("real")))
    return spark.read.schema(LISTING).parquet(out)


def read_bodies(
    files: DataFrame, partitions: int | None = None, universal_newlines: bool = False
) -> DataFrame:
    """Adds `content` and `error`: UTF-8 text, or NULL and why it could not be read."""
    if partitions is None:
        total = files.agg(F.sum("size").alias("s")).first()["s"] or 0
        cores = files.sparkSession.sparkContext.defaultParallelism
        partitions = max(cores, -(-total // _PARTITION_BYTES))
    schema = T.StructType(
        [
            *files.schema.fields,
            T.StructField("content", T.StringType()),
            T.StructField("error", T.StringType()),
        ]
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column("path").to_pylist()
            sizes = batch.column("size").to_pylist()
            start, held = 0, 0
            for row in range(len(paths) + 1):
                if row < len(paths) and (row == start or held + sizes[row] <= _BATCH_BYTES):
                    held += sizes[row]
                    continue
                if row > start:
                    yield _with_texts(batch.slice(start, row - start), paths[start:row],
                                      universal_newlines)
                start, held = row, sizes[row] if row < len(paths) else 0

    return files.repartition(partitions, "path").mapInArrow(read, schema)


def scan(
    spark: SparkSession,
    root: str,
    recursive: bool = True,
    include_hidden: bool = False,
) -> DataFrame:
    """Listing and bodies of all files that are not hidden."""
    return read_bodies(list_files(spark, root, recursive, include_hidden))


def readable(files: DataFrame) -> DataFrame:
    return files.filter(F.col("error").isNull())


def read_errors(files: DataFrame) -> DataFrame:
    """What was skipped and why."""
    return files.filter(F.col("error").isNotNull()).select("path", "error")


def as_documents(files: DataFrame) -> DataFrame:
    """The document table of an index: the path is the id."""
    return readable(files).select(
        F.col("path").alias("doc_id"),
        "content",
        F.create_map(
            F.lit("file_path"), F.col("path"),
            F.lit("file_name"), F.col("name"),
            F.lit("file_size"), F.col("size").cast("string"),
        ).alias("metadata"),
    )


def _with_texts(
    batch: pa.RecordBatch, paths: list[str], universal_newlines: bool
) -> pa.RecordBatch:
    texts, errors = [], []
    for path in paths:
        try:
            system, inner = open_folder(path)
            with system.open_input_stream(inner, compression=None) as stream:
                text = stream.read().decode("utf-8")
            if universal_newlines:
                text = text.replace("\r\n", "\n").replace("\r", "\n")
            texts.append(text)
            errors.append(None)
        except (OSError, UnicodeDecodeError) as e:
            texts.append(None)
            errors.append(f"{type(e).__name__}: {e}")
    return pa.RecordBatch.from_arrays(
        [*batch.columns, pa.array(texts, pa.string()), pa.array(errors, pa.string())],
        names=[*batch.schema.names, "content", "error"],
    )


class _Folders(InputPartition):
    """Folders one task lists: (path, whether with its subtree)."""

    def __init__(self, folders: list[tuple[str, bool]]):
        super().__init__(folders)
        self.folders = folders


class FileTree(DataSource):
    """spark.read.format('filetree').load(root), after the format was registered."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        return LISTING

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _TreeReader(
            self.options["path"],
            self.options.get("recursive", "true") == "true",
            int(self.options.get("tasks", "64")),
        )


class _TreeReader(DataSourceReader):
    def __init__(self, root: str, recursive: bool, tasks: int):
        self.recursive, self.tasks = recursive, tasks
        self.system, self.base = open_folder(root)
        # Paths come back in the form the root was given in.
        self.shown = root.rstrip("/")

    def partitions(self) -> list[InputPartition]:
        if not self.recursive:
            return [_Folders([(self.base, False)])]
        enough = max(_TOP_FOLDERS, 4 * self.tasks)
        opened: list[str] = []
        level = [self.base]
        while level and len(opened) + len(level) < enough:
            opened += level
            level = [d for folder in level for d in self._entries(folder)[0]]
        folders = [(d, True) for d in level] + [(d, False) for d in opened]
        return [_Folders(folders[i :: self.tasks]) for i in range(min(self.tasks, len(folders)))]

    def read(self, partition: _Folders) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        todo = list(partition.folders)
        while todo:
            folder, whole = todo.pop()
            folders, files = self._entries(folder)
            if whole:
                todo += [(d, True) for d in folders]
            for info in files:
                rows.append(self._row(info))
                if len(rows) == _ROWS:
                    yield self._batch(rows)
                    rows = []
        if rows:
            yield self._batch(rows)

    def _entries(self, folder: str) -> tuple[list[str], list[fs.FileInfo]]:
        folders, files = [], []
        for info in self.system.get_file_info(fs.FileSelector(folder)):
            if info.type == fs.FileType.Directory and not self._is_link(info.path):
                folders.append(info.path)
            elif info.type == fs.FileType.File:
                files.append(info)
        return folders, files

    def _is_link(self, path: str) -> bool:
        """Linked folders are not followed: they could lead back up."""
        if not isinstance(self.system, fs.LocalFileSystem):
            return False
        return os.path.islink(path)

    def _row(self, info: fs.FileInfo) -> tuple:
        rel = info.path[len(self.base.rstrip("/")) + 1 :]
        folder, _, name = rel.rpartition("/")
        dot = name.rfind(".")
        ext = name[dot:] if 0 < dot < len(name) - 1 else ""
        return f"{self.shown}/{rel}", rel, folder, name, ext, info.size or 0

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.string()] * 5 + [pa.int64()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), types)], names=LISTING.names
        )
