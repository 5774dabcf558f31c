"""Column functions on texts, and the ranges of a batch of texts by bytes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# A token is a maximal run of characters other than these.
BLANKS = r"[ \t\r\n\f\x0B]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text: Column | str) -> Column:
    return F.filter(F.split(_col(text), BLANKS), lambda t: t != "")


def n_tokens(text: Column | str) -> Column:
    return F.size(tokens(text))


def stamp(timestamp: Column) -> Column:
    """ISO text of a timestamp in the session's time zone."""
    return F.date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def header_block(path: Column, rel_path: Column, body: Column) -> Column:
    """One file inside a bundle."""
    return F.concat(
        F.lit("// Source: "), path, F.lit("\n// Relative path: "), rel_path,
        F.lit("\n"), body, F.lit("\n"),
    )


def byte_ranges(texts: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Start and end of runs of rows with at most `limit` bytes of text (or one row)."""
    sizes = pc.binary_length(texts).fill_null(0).to_pylist()
    start, held = 0, 0
    for row, size in enumerate(sizes):
        if row > start and held + size > limit:
            yield start, row
            start, held = row, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)
