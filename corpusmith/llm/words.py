"""Words and their 64-bit hashes, for numpy code inside tasks.

A word is a run of characters other than the six ASCII blanks.  Hashes depend on the word's
bytes alone, so every task gives the same ones.  Texts are worked on in pieces of about a
megabyte, cut between words, so a very long text costs eight bytes a word and no more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = b" \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
PIECE_BYTES = 1 << 20

_IS_BLANK = np.zeros(256, dtype=bool)
_IS_BLANK[list(BLANKS)] = True
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finisher of splitmix64)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_OF_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_BASE = _U(0x9E3779B97F4A7C55)
_POWERS = np.multiply.accumulate(np.full(64, _BASE, dtype=_U))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.multiply.accumulate(np.full(2 * n, _BASE, dtype=_U))
    return _POWERS


def lower(text: bytes) -> bytes:
    """A-Z in lower case; every other byte as it is."""
    return text.translate(_LOWER)


def _hash_piece(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, dtype=np.uint8)
    blank = _IS_BLANK[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).view(np.int8)))
    if not len(edge):
        return np.empty(0, dtype=_U)
    starts, ends = edge[::2], edge[1::2]
    length = ends - starts
    first = np.cumsum(length) - length
    value = _OF_BYTE[raw[~blank]]
    value *= _powers(int(length.max()))[np.arange(len(value)) - np.repeat(first, length)]
    return mix(np.add.reduceat(value, first) + length.astype(_U))


def word_hashes(text: bytes) -> np.ndarray:
    """The hash of every word of a text, in order."""
    if len(text) <= PIECE_BYTES:
        return _hash_piece(text)
    out, at = [], 0
    while at < len(text):
        end = at + PIECE_BYTES
        while end < len(text) and not _IS_BLANK[text[end]]:
            end += 1
        out.append(_hash_piece(text[at:end]))
        at = end
    return np.concatenate(out)


def batch_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of many texts in one array, and where each text's begin.

    The second array has one entry more than there are texts.
    """
    out, counts, pending, size = [], [], [], 0

    def flush() -> None:
        data = b"\n".join(pending)
        out.append(_hash_piece(data))
        ends = np.cumsum([len(t) + 1 for t in pending])
        raw = np.frombuffer(data, dtype=np.uint8)
        inside = ~_IS_BLANK[raw]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        at = np.flatnonzero(begins)
        counts.extend(np.diff(np.searchsorted(at, ends), prepend=0).tolist())
        pending.clear()

    for text in texts:
        if len(text) > PIECE_BYTES:
            if pending:
                flush()
            hashes = word_hashes(text)
            out.append(hashes)
            counts.append(len(hashes))
            size = 0
            continue
        pending.append(text)
        size += len(text)
        if size >= PIECE_BYTES:
            flush()
            size = 0
    if pending:
        flush()
    hashes = np.concatenate(out) if out else np.empty(0, dtype=_U)
    return hashes, np.concatenate(([0], np.cumsum(counts))).astype(np.int64)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of every run of `size` consecutive word hashes."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, dtype=_U)
    total = np.zeros(n, dtype=_U)
    for i in range(size):
        total *= _BASE
        total += words[i:i + n]
    return mix(total)


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a piece holds about `limit` bytes of the column's texts."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = batch.column(column).cast(pa.large_string()).fill_null("")
        sizes = pa.compute.binary_length(sizes).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), n]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """A text column as bytes; null is the empty text."""
    return batch.column(column).cast(pa.large_binary()).fill_null(b"").to_pylist()


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64)


def word_array(text: Column) -> Column:
    """The words of a text as a native array; null has none."""
    return F.coalesce(
        F.array_remove(F.split(text, GAP), ""), F.array().cast("array<string>")
    )
