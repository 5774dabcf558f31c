"""Removal of recurring passages by sharded Aho-Corasick automata.

A window is `window` consecutive words of a text; it recurs if the same words also start
anywhere else, in another document or in the same one.  Words in a recurring window go.

1. Anchors.  Each window is named by the smallest hash of the ANCHOR-word runs inside it.  Equal
   windows have equal anchors, and neighbours mostly share one, so a text is a list of
   runs of windows, about one in fifteen words.  An anchor seen once cannot hold a recurring window.
2. Segments.  Each different text (copies count as one) sends the words of its runs with
   recurring anchors to the shard of the anchor.  An anchor seen more than `hot` times sends
   its windows one by one instead, each to the shard of its own words, where equal ones are
   alike, so a phrase that very many texts share never meets in one task with all that stands
   around it.
3. Automata.  A shard takes whole anchors up to a bounded number of words, confirms which windows
   come twice, compiles the fewest windows that cover them into one automaton (a word is one
   symbol) and streams its segments through it; every match is removed.
4. Matches meet their text again and the kept words are written.

A text with copies needs no automaton: all its windows recur.  Texts are told apart by 96
bits of hash, words and anchors are compared as they are inside a shard; a text crosses
the network once.  Null and empty texts have no words.  Ids are carried along only: null and
repeated ones are fine.  Repeated rows are copies of each other.  An empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .words import batch_hashes, pieces, signed, texts_of, window_hashes

WINDOW = 35
ANCHOR = 8
HOT = 4096
SHARD_WORDS = 400_000


def _smallest(values: np.ndarray, size: int) -> np.ndarray:
    """The minimum of every `size` consecutive values."""
    done, out = 1, values
    while 2 * done <= size:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    rest = size - done
    return np.minimum(out[:len(out) - rest], out[rest:]) if rest else out


def _runs(words: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: text number, first window, number of windows, anchor,
    how often the anchor stands in the run.

    A run is never longer than the windows that one place of an anchor can serve.
    """
    empty = np.empty(0, dtype=np.int64)
    if len(words) < window:
        return empty, empty, empty, empty, empty
    k = min(ANCHOR, window)
    grams = window_hashes(words, k)
    anchors = _smallest(grams, window - k + 1)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    inside = np.flatnonzero(text[:len(anchors)] == text[window - 1:window - 1 + len(anchors)])
    if not len(inside):
        return empty, empty, empty, empty, empty
    value, owner = anchors[inside], text[inside]
    new = np.ones(len(inside), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(inside)))
    most = window - k + 1
    # Longer runs (one phrase over and over) are cut.
    parts = -(-length // most)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    first = np.repeat(first, parts) + nth * most
    length = np.minimum(np.repeat(length, parts) - nth * most, most)
    # A phrase over and over has one anchor at several places of one run.
    reach = length + most - 1
    begin = np.cumsum(reach) - reach
    places = np.repeat(inside[first] - begin, reach) + np.arange(reach.sum())
    times = np.add.reduceat(grams[places] == np.repeat(value[first], reach), begin, dtype=np.int64)
    return owner[first], inside[first] - at[owner[first]], length, signed(value[first]), times


def text_key(text: Column) -> list[Column]:
    """96 bits that stand for a text."""
    return [F.xxhash64(text).alias("k1"), F.hash(text).alias("k2")]


def _anchor_rows(window: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 2 << 20):
            words, at = batch_hashes(texts_of(batch))
            owner, start, length, anchor, times = _runs(words, at, window)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(anchor), batch.column("k1").take(pa.array(owner)), batch.column("k2").take(pa.array(owner)),
                    pa.array(start.astype(np.int32)), pa.array(length.astype(np.int32)), pa.array(times.astype(np.int32)),
                ],
                ["anchor", "k1", "k2", "start", "n", "times"],
            )

    return rows


def _segment_rows(window: int):
    """The words of the listed runs: shard key, where they start, the words."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 2 << 20):
            shard, owner, starts, segments = [], [], [], []
            for i, (text, runs) in enumerate(zip(texts_of(batch), batch.column("runs").to_pylist())):
                words = text.split()
                for run in runs:
                    start, n = run["start"], run["n"]
                    if not run["hot"]:
                        shard.append(run["anchor"])
                        owner.append(i)
                        starts.append(start)
                        segments.append(b" ".join(words[start:start + n + window - 1]))
                        continue
                    for j in range(start, start + n):
                        segment = b" ".join(words[j:j + window])
                        shard.append(xxhash.xxh64_intdigest(segment) - (1 << 63))
                        owner.append(i)
                        starts.append(j)
                        segments.append(segment)
            take = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(shard, pa.int64()), batch.column("k1").take(take), batch.column("k2").take(take),
                    pa.array(starts, pa.int32()), pa.array(segments, pa.binary()),
                ],
                ["shard", "k1", "k2", "start", "words"],
            )

    return rows


class _Shard:
    """Some whole anchors with all their segments."""

    def __init__(self, window: int):
        self.window = window
        self.symbols: dict[bytes, str] = {}
        self.coded: list[str] = []
        self.rows: list[tuple[int, int, int]] = []
        self.size = 0

    def add(self, k1: int, k2: int, start: int, words: bytes) -> None:
        symbols, out = self.symbols, []
        for w in words.split(b" "):
            s = symbols.get(w)
            if s is None:
                code = len(symbols) + 0x100
                s = symbols[w] = chr(code if code < 0xD800 else code + 0x800)
            out.append(s)
        self.coded.append("".join(out))
        self.rows.append((k1, k2, start))
        self.size += len(out)

    def matches(self) -> Iterator[tuple[int, int, int, int]]:
        """k1, k2 and ranges of words (from, past the end) that recur."""
        window = self.window
        seen = Counter(s[i:i + window] for s in self.coded for i in range(len(s) - window + 1))
        again = {w for w, n in seen.items() if n > 1}
        del seen
        if not again:
            return
        patterns = set()
        for s in self.coded:
            last = -window  # the last window taken
            for i in range(len(s) - window + 1):
                if s[i:i + window] not in again:
                    continue
                more = i + 1 <= len(s) - window and s[i + 1:i + 1 + window] in again
                # A window is needed at both ends of a stretch and one in `window` between.
                if i - last >= window or not more or s[i - 1:i - 1 + window] not in again:
                    patterns.add(s[i:i + window])
                    last = i
        automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for p in patterns:
            automaton.add_word(p)
        automaton.make_automaton()
        for s, (k1, k2, start) in zip(self.coded, self.rows):
            open_from = open_to = -1
            for last, _ in automaton.iter(s):
                low = last - window + 1
                if low > open_to:
                    if open_to > open_from:
                        yield k1, k2, start + open_from, start + open_to
                    open_from = low
                open_to = last + 1
            if open_to > open_from:
                yield k1, k2, start + open_from, start + open_to


def _match_rows(window: int, shard_words: int):
    """Shards of sorted segments: ranges of recurring words."""

    def out(shard: _Shard) -> Iterator[pa.RecordBatch]:
        found = list(shard.matches())
        if found:
            k1, k2, low, high = zip(*found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(k1, pa.int64()), pa.array(k2, pa.int32()), pa.array(low, pa.int32()), pa.array(high, pa.int32())],
                ["k1", "k2", "low", "high"],
            )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, key = _Shard(window), None
        for batch in batches:
            for anchor, k1, k2, start, words in zip(*(batch.column(c).to_pylist() for c in ("shard", "k1", "k2", "start", "words"))):
                if anchor != key and shard.size >= shard_words:
                    yield from out(shard)
                    shard = _Shard(window)
                key = anchor
                shard.add(k1, k2, start, words)
        yield from out(shard)

    return rows


def _kept(window: int):
    """n_words, n_removed and the kept words of each text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 2 << 20):
            n_words, n_removed, kept = [], [], []
            columns = (batch.column(c).to_pylist() for c in ("copies", "gone"))
            for text, copies, gone in zip(texts_of(batch), *columns):
                words = text.split()
                n = len(words)
                if copies > 1 and n >= window:
                    words = []
                elif gone:
                    stays = np.ones(n, dtype=bool)
                    for r in gone:
                        stays[r["low"]:r["high"]] = False
                    words = [words[i] for i in np.flatnonzero(stays)]
                n_words.append(n)
                n_removed.append(n - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column("k1"), batch.column("k2"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                 pa.array(kept, pa.binary()).cast(pa.string())],
                ["k1", "k2", "n_words", "n_removed", "kept"],
            )

    return rows


def kept_texts(
    docs: DataFrame, text: str = "text", window: int = WINDOW, hot: int = HOT, shard_words: int = SHARD_WORDS
) -> DataFrame:
    """One row per different text: k1, k2 (see text_key), n_words, n_removed, kept."""
    if window < 1:
        raise ValueError(f"window must be positive, not {window}")
    plain = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(plain.alias("text")).select("text", *text_key(F.col("text")))
    runs = cut_lineage(rows.mapInArrow(_anchor_rows(window), "anchor long, k1 long, k2 int, start int, n int, times int"))
    # Copies of a text count here too, which only lets more anchors through.
    counts = runs.groupBy("anchor").agg(F.sum("times").alias("all_times")).filter("all_times > 1")
    again = (
        runs.join(counts, "anchor")
        .select("k1", "k2", F.struct("anchor", "start", "n", (F.col("all_times") > hot).alias("hot")).alias("run"))
        .groupBy("k1", "k2").agg(F.collect_set("run").alias("runs"))
    )
    texts = rows.groupBy("k1", "k2").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    segments = texts.join(again, ["k1", "k2"]).select("k1", "k2", "text", "runs").mapInArrow(
        _segment_rows(window), "shard long, k1 long, k2 int, start int, words binary"
    )
    matches = (
        segments.repartition("shard").sortWithinPartitions("shard")
        .mapInArrow(_match_rows(window, shard_words), "k1 long, k2 int, low int, high int")
        .groupBy("k1", "k2").agg(F.collect_list(F.struct("low", "high")).alias("gone"))
    )
    return texts.join(matches, ["k1", "k2"], "left").mapInArrow(
        _kept(window), "k1 long, k2 int, n_words long, n_removed long, kept string"
    )


def drop_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (the words left, single blanks)."""
    done = kept_texts(docs, text, window)
    ids = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ids = ids.select("doc_id", *text_key(F.col("text")))
    return ids.join(done, ["k1", "k2"]).select("doc_id", "n_words", "n_removed", "kept")


def with_digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """drop_repeats with the SHA-256 of the kept words in place of them."""
    done = kept_texts(docs, text, window).select(
        "k1", "k2", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    )
    ids = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return ids.select("doc_id", *text_key(F.col("text"))).join(done, ["k1", "k2"]).select(
        "doc_id", "n_words", "n_removed", "kept_sha256"
    )


def digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()
