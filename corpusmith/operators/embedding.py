"""Turning texts into unit vectors, one Arrow batch at a time.

An embedder is a name, a dimension and a factory.  The factory runs once per task on
the executor (a place to open a model) and gives a function from a list of texts (or
from an Arrow array of them) to a matrix.  The built-in one hashes words and needs no
model files.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import byte_ranges
from ..settings import BATCH_SIZE, VECTOR_DIM

# Texts hashed at a time, and bytes of them: the matrix of counts and the list of words stay small.
_HASH_ROWS = 8192
_HASH_BYTES = 4 << 20
# Bytes as they count in a lower-case text: word characters stay, all others part words.
_WORD_BYTES = np.full(256, ord(" "), dtype=np.uint8)
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789_":
    _WORD_BYTES[_c] = _c


@dataclass(frozen=True)
class Embedder:
    """name and dim go into the index's manifest and are checked on load."""

    name: str
    dim: int
    open: Callable[[], Callable[..., np.ndarray]]
    batch_size: int = BATCH_SIZE
    normalize: bool = True
    takes_arrow: bool = False


def hash_embedder(dim: int = VECTOR_DIM) -> Embedder:
    """Signed feature hashing of the lower-case words of a text."""

    return Embedder(
        name=f"hash-{dim}", dim=dim, open=lambda: lambda texts: _hash_words(texts, dim),
        batch_size=_HASH_ROWS, takes_arrow=True,
    )


def embedding(
    text: Column | str, embedder: Embedder, on_error: str = "raise"
) -> Column:
    """The vector of a text as ARRAY<FLOAT>; a NULL text has no vector.

    on_error 'raise' fails the task with the model's own error as cause; 'null' gives
    the texts of a failing model batch to the model one by one, and only those that fail
    alone have no vector.
    """
    if on_error not in ("raise", "null"):
        raise ValueError(f"on_error must be 'raise' or 'null', not {on_error!r}")

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            encode = embedder.open()
        except Exception as e:
            raise RuntimeError(f"Model initialization failed: {e}") from e
        for texts in batches:
            parts = [
                _encode(encode, texts.slice(at, embedder.batch_size), embedder, on_error)
                for at in range(0, len(texts), embedder.batch_size)
            ]
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.float32()))

    return _arrow_column(run, T.ArrayType(T.FloatType()), text)


def pack(vector: Column | str) -> Column:
    """A vector as its 32-bit floats in one BINARY value.

    The form for storage: a scan hands it to Arrow as it is, where an array is taken
    apart and put together again entry by entry.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            sizes = pc.list_value_length(lists).fill_null(0)
            ends = np.cumsum(sizes.to_numpy(zero_copy_only=False), dtype=np.int64) * 4
            data = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
            offsets = np.concatenate([[0], ends]).astype(np.int32)
            packed = pa.Array.from_buffers(
                pa.binary(), len(lists), [None, pa.py_buffer(offsets), pa.py_buffer(data)]
            )
            yield pc.if_else(lists.is_valid(), packed, None)

    return _arrow_column(run, T.BinaryType(), vector)


def unpack(packed: Column | str) -> Column:
    """ARRAY<FLOAT> of a packed vector."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for values in batches:
            values = pa.concat_arrays([values])
            sizes = pc.binary_length(values).fill_null(0).to_numpy(zero_copy_only=False) // 4
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            flat = np.frombuffer(b"".join(values.drop_null().to_pylist()), dtype=np.float32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pc.if_else(values.is_valid(), lists, None)

    return _arrow_column(run, T.ArrayType(T.FloatType()), packed)


def _arrow_column(run: Callable, kind: T.DataType, column: Column | str) -> Column:
    # The argument and the result as the iterator kind of Arrow UDF wants them declared.
    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(kind)(run)(F.col(column) if isinstance(column, str) else column)


def with_embedding(
    df: DataFrame,
    embedder: Embedder,
    text: str = "content",
    out: str = "embedding",
    on_error: str = "raise",
) -> DataFrame:
    return df.withColumn(out, embedding(text, embedder, on_error))


def _encode(
    encode: Callable[..., np.ndarray],
    texts: pa.Array,
    embedder: Embedder,
    on_error: str,
) -> pa.Array:
    known = texts.drop_null()
    if not len(known):
        return pa.nulls(len(texts), pa.list_(pa.float32()))
    try:
        given = known if embedder.takes_arrow else known.to_pylist()
        matrix = np.asarray(encode(given), dtype=np.float64)
        if matrix.shape != (len(known), embedder.dim):
            raise ValueError(
                f"model gave shape {matrix.shape}, expected {(len(known), embedder.dim)}"
            )
    except Exception as e:
        if on_error == "null":
            if len(texts) == 1:
                return pa.nulls(1, pa.list_(pa.float32()))
            alone = (texts.slice(i, 1) for i in range(len(texts)))
            return pa.concat_arrays([_encode(encode, t, embedder, on_error) for t in alone])
        raise RuntimeError(f"Failed to generate embeddings: {e}") from e
    if embedder.normalize:
        matrix = _unit(matrix)
    offsets = np.arange(len(known) + 1, dtype=np.int32) * embedder.dim
    vectors = pa.ListArray.from_arrays(
        pa.array(offsets), pa.array(matrix.astype(np.float32).ravel())
    )
    if not texts.null_count:
        return vectors
    place = np.cumsum(texts.is_valid().to_numpy(zero_copy_only=False)) - 1
    return vectors.take(pa.array(place, mask=texts.is_null().to_numpy(zero_copy_only=False)))


def _unit(matrix: np.ndarray) -> np.ndarray:
    length = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))[:, None]
    return np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)


def _hash_words(texts: pa.Array, dim: int) -> np.ndarray:
    """Signed word counts per position; the caller scales them to unit length."""
    ranges = byte_ranges(texts, _HASH_BYTES)
    return np.concatenate([np.zeros((0, dim)), *(_hash_piece(texts.slice(s, e - s), dim) for s, e in ranges)])


def _hash_piece(texts: pa.Array, dim: int) -> np.ndarray:
    lists = pc.ascii_split_whitespace(_only_words(texts))
    words = lists.flatten().dictionary_encode()
    row = np.repeat(
        np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    )
    # Every distinct word of the piece is hashed once.
    distinct = words.dictionary.to_pylist()
    codes = np.array(
        [int(hashlib.md5(w.encode()).hexdigest()[:8], 16) for w in distinct], dtype=np.int64
    )
    sign = np.where((codes // dim) % 2 == 0, 1.0, -1.0)
    sign[[i for i, w in enumerate(distinct) if w == ""]] = 0.0
    which = words.indices.to_numpy(zero_copy_only=False)
    cell = row * dim + (codes % dim)[which]
    counts = np.bincount(cell, weights=sign[which], minlength=len(texts) * dim)
    return counts.reshape(len(texts), dim)


def _only_words(texts: pa.Array) -> pa.Array:
    """Lower-case texts with a blank for every byte outside [a-z0-9_]."""
    lower = pa.concat_arrays([pc.utf8_lower(texts)]).cast(pa.large_string())
    _, offsets, data = lower.buffers()
    if data is None:
        return lower
    kept = _WORD_BYTES[np.frombuffer(data, dtype=np.uint8)]
    return pa.LargeStringArray.from_buffers(len(lower), offsets, pa.py_buffer(kept))
