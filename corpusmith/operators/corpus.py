"""What a collection consists of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..settings import (
    NO_DIRECTORY_MESSAGE, NO_DOCUMENTS_MESSAGE, SUCCESS_PREFIX, SUCCESS_SUFFIX,
)


def extensions(files: DataFrame) -> DataFrame:
    """The distinct endings, '' for files without one."""
    return files.select("ext").distinct()


def profile(files: DataFrame, *by: str, size: str = "size") -> DataFrame:
    """Files and their sizes per combination of columns, with subtotals and a total.

    `grouping` tells subtotals from rows: one bit per column that was summed over.
    """
    return files.rollup(*by).agg(
        F.grouping_id().alias("grouping"),
        F.count("*").alias("n_files"),
        F.sum(size).alias("size"),
    )


def chunk_profile(chunks: DataFrame, *by: str) -> DataFrame:
    """The same for chunks; a file is counted at its first chunk."""
    return chunks.rollup(*by).agg(
        F.grouping_id().alias("grouping"),
        F.count_if(F.col("chunk_no") == 0).alias("n_files"),
        F.count("*").alias("n_chunks"),
        F.sum("n_tokens").alias("n_tokens"),
    )


def files_per_folder(files: DataFrame) -> DataFrame:
    """Counts listed files, also those that could not be read."""
    return files.groupBy("dir").agg(F.count("*").alias("n_files"))


def load_status_columns(n_documents: Column) -> tuple[Column, Column]:
    """Status and message of a count, as columns: the same answers as `load_status`, in one aggregate."""
    status = F.when(n_documents == 0, F.lit("empty")).otherwise(F.lit("ok"))
    message = F.when(n_documents == 0, F.lit(NO_DOCUMENTS_MESSAGE)).otherwise(
        F.concat(F.lit(SUCCESS_PREFIX), n_documents.cast("string"), F.lit(SUCCESS_SUFFIX))
    )
    return status, message


def load_status(n_documents: int | None) -> tuple[str, str]:
    """Status and message after loading a folder; None for a folder that is missing."""
    if n_documents is None:
        return "missing", NO_DIRECTORY_MESSAGE
    if n_documents == 0:
        return "empty", NO_DOCUMENTS_MESSAGE
    return "ok", f"{SUCCESS_PREFIX}{n_documents}{SUCCESS_SUFFIX}"
