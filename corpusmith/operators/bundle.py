"""One text per folder, made of all its files.

A folder may hold any share of the data, so its text is cut into parts: sizes are
summed per folder first (names and sizes only), and the folders above `part_bytes` are
cut into ranges of paths.  The parts of a folder, joined in their order by the same
separator as the files, are its whole text whatever `part_bytes` is.  No part is longer
than `part_bytes` and its last file.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import header_block
from ..session import cut_lineage
from ..settings import BUNDLE_FOLDER
from ..sources.filetree import open_folder

PART_BYTES = 64 << 20
SEPARATOR = "\n"


def bundles(
    files: DataFrame, listing: DataFrame | None = None, part_bytes: int = PART_BYTES
) -> DataFrame:
    """dir, part_no, n_files, text from (dir, path, rel_path, size, content).

    Files that could not be read count in n_files (of part 0 where there are several)
    but add no text.  Inside a part files
    come in the order of their paths.  Pass the listing the files were read from, and
    sizes are summed without reading the files twice.
    """
    blocks = files.select(
        "dir", "rel_path",
        header_block(F.col("path"), F.col("rel_path"), F.col("content")).alias("block"),
    )
    return (
        _with_part(blocks, files if listing is None else listing, part_bytes)
        .groupBy("dir", "part_no")
        .agg(
            F.count("*").alias("n_files"),
            F.sort_array(F.collect_list(
                F.when(F.col("block").isNotNull(), F.struct("rel_path", "block"))
            )).alias("_sorted"),
        )
        .select(
            "dir", "part_no", "n_files",
            F.array_join(F.col("_sorted.block"), SEPARATOR).alias("text"),
        )
    )


def _with_part(blocks: DataFrame, sizes: DataFrame, part_bytes: int) -> DataFrame:
    """Adds part_no: consecutive from 0, a range of paths each, cut by running bytes."""
    large = sizes.groupBy("dir").agg(F.sum("size").alias("total")).filter(F.col("total") > part_bytes)
    large = cut_lineage(large.select("dir"))
    if large.isEmpty():
        return blocks.withColumn("part_no", F.lit(0).cast("long"))
    # Bodies are read once; what follows reads names and lengths alone.
    blocks = cut_lineage(blocks.withColumn("bytes", F.octet_length("block").cast("long")))
    names = (
        blocks.filter("bytes is not null").join(large, "dir", "left_semi")
        .groupBy("dir", "rel_path").agg(F.sum("bytes").alias("bytes"))
    )
    # Running sums in two steps, so no task sorts a whole folder.
    ranged = cut_lineage(
        names.repartitionByRange("dir", "rel_path").withColumn("range", F.spark_partition_id())
    )
    within = Window.partitionBy("dir", "range").orderBy("rel_path")
    ranges = ranged.groupBy("dir", "range").agg(F.sum("bytes").alias("all")).withColumn(
        "before", F.sum("all").over(Window.partitionBy("dir").orderBy("range")) - F.col("all")
    )
    placed = (
        ranged.withColumn("start", F.sum("bytes").over(within) - F.col("bytes"))
        .join(ranges.select("dir", "range", "before"), ["dir", "range"])
        .select("dir", "rel_path", F.floor((F.col("before") + F.col("start")) / part_bytes).alias("cut"))
    )
    # A file larger than a part leaves cuts unused.
    numbers = placed.select("dir", "cut").distinct().withColumn(
        "part_no", F.row_number().over(Window.partitionBy("dir").orderBy("cut")).cast("long") - 1
    )
    placed = cut_lineage(placed.join(numbers, ["dir", "cut"]).select("dir", "rel_path", "part_no"))
    return blocks.join(placed, ["dir", "rel_path"], "left").select(
        "dir", "rel_path", "block", F.coalesce("part_no", F.lit(0).cast("long")).alias("part_no")
    )


def bundle_path(root: str) -> Callable[[str, int], str]:
    """Where the bundle of a folder goes: the mirrored folder below the output folder."""
    top = posixpath.basename(root.rstrip("/"))

    def path(folder: str, part_no: int) -> str:
        name = posixpath.basename(folder) or top
        part = f".part{part_no:05d}" if part_no else ""
        return posixpath.join(
            root.rstrip("/"), BUNDLE_FOLDER, folder, f"{name}_concatenated{part}.py"
        )

    return path


def write_bundles(parts: DataFrame, root: str) -> DataFrame:
    """Writes every part to its own file and returns (out_path, n_files) per file.

    A folder in one part gives `<folder>/<name>_concatenated.py`; further parts follow as
    `.part00001.py` and so on.  A task that runs twice writes the same file again: the
    text goes to a name of its own first and is then moved into place.
    """
    path_of = bundle_path(root)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for folder, part_no, text in zip(
                *(batch.column(c).to_pylist() for c in ("dir", "part_no", "text"))
            ):
                target = path_of(folder, part_no)
                write_text(target, (SEPARATOR if part_no else "") + text)
                done.append(target)
            yield pa.RecordBatch.from_arrays(
                [pa.array(done, pa.string()), batch.column("n_files")],
                names=["out_path", "n_files"],
            )

    return parts.mapInArrow(write, "out_path string, n_files bigint")


def make_folders(folders: DataFrame, root: str) -> int:
    """Makes the mirrored folder of every `dir`, also of those without a bundle."""
    top = posixpath.join(root.rstrip("/"), BUNDLE_FOLDER)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column("dir").to_pylist():
                system, inner = open_folder(posixpath.join(top, folder))
                system.create_dir(inner, recursive=True)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    made = folders.select("dir").distinct().mapInArrow(make, "n bigint")
    return made.agg(F.sum("n").alias("n")).first()["n"] or 0


def write_text(path: str, text: str) -> None:
    system, inner = open_folder(path)
    system.create_dir(posixpath.dirname(inner), recursive=True)
    own = f"{inner}.{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(own, compression=None) as stream:
        stream.write(text.encode("utf-8"))
    if system.get_file_info(inner).type != fs.FileType.NotFound and not isinstance(
        system, fs.LocalFileSystem
    ):
        system.delete_file(inner)
    system.move(own, inner)
