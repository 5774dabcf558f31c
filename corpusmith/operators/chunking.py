"""Cutting texts into overlapping chunks.

`line` chunks keep whole lines and know their line range; where a chunk starts
depends on where the one before it ended, so a document is cut in one pass inside an
Arrow batch, next to where it was read and without a shuffle.  `window` chunks are
plain token windows and stay in the JVM.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import byte_ranges, tokens
from ..settings import CHUNK_OVERLAP, CHUNK_SIZE, check_chunking

# A token of a line, the complement of the blanks.
_TOKEN = r"[^ \t\r\f\x0B\n]+"
# Text bytes cut at a time: lines, chunks and counts take several times as much.
_PIECE_BYTES = 4 << 20

_CHUNK_FIELDS = [
    T.StructField("chunk_no", T.IntegerType(), False),
    T.StructField("n_chunks", T.IntegerType(), False),
    T.StructField("start_line", T.IntegerType(), False),
    T.StructField("end_line", T.IntegerType(), False),
    T.StructField("n_tokens", T.LongType(), False),
]


def chunk_lines(
    docs: DataFrame,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    text: str = "content",
) -> DataFrame:
    """Chunks of whole lines, at most `size` tokens unless a single line is longer.

    A line has max(1, tokens) tokens.  The next chunk starts at the earliest line from
    which the end of this one holds at most `overlap` tokens.  All other columns of the
    document are carried along; the text column becomes the chunk's text.
    """
    check_chunking(size, overlap)
    docs = docs.filter(F.col(text).isNotNull())
    schema = T.StructType([*docs.schema.fields, *_CHUNK_FIELDS])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _pieces(batch, text):
                yield _cut_piece(piece, text, size, overlap)

    return docs.mapInArrow(cut, schema)


def chunk_windows(
    docs: DataFrame,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    text: str = "content",
) -> DataFrame:
    """Windows of `size` tokens every `size - overlap` tokens, joined by one blank."""
    check_chunking(size, overlap)
    step = size - overlap
    last = F.greatest(
        F.lit(0),
        F.ceil(F.greatest(F.lit(0), F.size("_tokens") - overlap) / F.lit(step)).cast("int") - 1,
    )
    others = [c for c in docs.columns if c != text]

    def window(k: Column) -> Column:
        part = F.slice("_tokens", k * step + 1, size)
        return F.struct(F.array_join(part, " ").alias("text"), F.size(part).alias("n"))

    # Windows are made inside the row: exploding first would copy all tokens into each.
    # The outer kind of explode, since a plain one adds a filter that cuts the text twice.
    return (
        docs.filter(F.col(text).isNotNull())
        .withColumn("_tokens", tokens(text))
        .withColumn("_windows", F.transform(F.sequence(F.lit(0), last), window))
        .select(*others, F.posexplode_outer("_windows").alias("chunk_no", "_w"))
        .select(
            *others, F.col("_w.text").alias(text), "chunk_no", F.col("_w.n").alias("n_tokens")
        )
    )


def line_numbers(docs: DataFrame, text: str = "content") -> DataFrame:
    """One row per line: its number from 1, its tokens and the running total.

    The running total stays inside one document, hence inside one row of the input: it
    needs no window and no shuffle.
    """
    docs = docs.filter(F.col(text).isNotNull())
    fields = [
        *docs.schema.fields,
        T.StructField("line_no", T.IntegerType(), False),
        T.StructField("n_tokens", T.LongType(), False),
        T.StructField("running_tokens", T.LongType(), False),
    ]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _pieces(batch, text):
                lines, starts, counts = _lines(piece.column(text))
                owner = np.repeat(np.arange(piece.num_rows), np.diff(starts))
                total = np.concatenate([[0], np.cumsum(counts)])
                columns = _others(piece, text, owner)
                columns[text] = lines
                columns["line_no"] = pa.array(
                    np.arange(len(owner)) - starts[owner] + 1, pa.int32()
                )
                columns["n_tokens"] = pa.array(counts)
                columns["running_tokens"] = pa.array(total[1:] - total[starts[owner]])
                yield _batch(piece, columns)

    return docs.mapInArrow(number, T.StructType(fields))


def chunk_id(doc_id: Column | str = "doc_id", chunk_no: Column | str = "chunk_no") -> Column:
    """The same for every build of the same text, whatever the run."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    chunk_no = F.col(chunk_no) if isinstance(chunk_no, str) else chunk_no
    return F.sha2(F.concat_ws(":", doc_id.cast("string"), chunk_no.cast("string")), 256)


def with_links(chunks: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """chunk_id and the ids before and after it in the document.

    Ids follow from document and number, so the neighbours' ids need no window.
    """
    no = F.col("chunk_no")
    return (
        chunks.withColumn("chunk_id", chunk_id(doc_id))
        .withColumn("prev_id", F.when(no > 0, chunk_id(doc_id, no - 1)))
        .withColumn(
            "next_id", F.when(no < F.col("n_chunks") - 1, chunk_id(doc_id, no + 1))
        )
    )


def _pieces(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    for start, end in byte_ranges(batch.column(text), _PIECE_BYTES):
        yield batch.slice(start, end - start)


def _lines(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All lines, where each document's lines start, and the tokens of each line."""
    lists = pc.split_pattern(texts, "\n")
    lines = lists.flatten()
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    counts = pc.count_substring_regex(lines, _TOKEN).to_numpy(zero_copy_only=False)
    return lines, starts, np.maximum(counts, 1).astype(np.int64)


def _others(piece: pa.RecordBatch, text: str, owner: np.ndarray) -> dict[str, pa.Array]:
    take = pa.array(owner, pa.int64())
    return {
        name: piece.column(name).take(take) for name in piece.schema.names if name != text
    }


def _batch(piece: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    names = [*piece.schema.names, *(c for c in columns if c not in piece.schema.names)]
    return pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)


def _cut_piece(
    piece: pa.RecordBatch, text: str, size: int, overlap: int
) -> pa.RecordBatch:
    texts = piece.column(text)
    lines, starts, counts = _lines(texts)
    widths = pc.binary_length(lines).to_numpy(zero_copy_only=False) + 1
    owner, number, total, first, last, held, contents = [], [], [], [], [], [], []
    for row in range(piece.num_rows):
        here = slice(starts[row], starts[row + 1])
        cum = [0, *accumulate(counts[here].tolist())]
        at = [0, *accumulate(widths[here].tolist())]
        raw = texts[row].as_buffer().to_pybytes()
        spans = _spans(cum, size, overlap)
        for chunk_no, (s, e) in enumerate(spans):
            owner.append(row)
            number.append(chunk_no)
            total.append(len(spans))
            first.append(s + 1)
            last.append(e + 1)
            held.append(cum[e + 1] - cum[s])
            contents.append(raw[at[s] : at[e + 1] - 1])
    columns = _others(piece, text, np.array(owner, dtype=np.int64))
    columns[text] = pa.array(contents, pa.binary()).cast(texts.type)
    columns["chunk_no"] = pa.array(number, pa.int32())
    columns["n_chunks"] = pa.array(total, pa.int32())
    columns["start_line"] = pa.array(first, pa.int32())
    columns["end_line"] = pa.array(last, pa.int32())
    columns["n_tokens"] = pa.array(held, pa.int64())
    return _batch(piece, columns)


def _spans(cum: list[int], size: int, overlap: int) -> list[tuple[int, int]]:
    """First and last line (from 0) of every chunk; cum are running token totals."""
    n, s, spans = len(cum) - 1, 0, []
    while True:
        e = max(s, bisect_right(cum, cum[s] + size) - 2)
        spans.append((s, e))
        if e == n - 1:
            return spans
        s = max(s + 1, bisect_left(cum, cum[e + 1] - overlap))
