"""Benchmark decontamination by one Aho-Corasick automaton.

Questions and answers are normalised (A-Z lowered, words are runs of ASCII letters and
digits and of all characters beyond ASCII) and cut into windows of `window` words; an item
of fewer words is one window.  Each different word of the benchmark becomes one symbol, and
one automaton holds all windows as strings of symbols.  Every document is normalised the same
way, written in these symbols and scanned once.  Word numbers of the hits map back to
characters of the text as it came.

What is sent at once has a bounded size: a benchmark of more than `block_words` words is cut into
blocks of at most so many (a longer item into pieces that share window - 1 words, so each of its
windows is whole in one).  With one block documents stay where they are read: no shuffle, and a
hit costs the same in a document of any group.  With more, documents get row numbers and are
written once, scanned once a block, and merged by row: the union of hit words and of items.
A caller who wants no such benchmark gives `max_words`; more words than that are a ValueError.

Nulls, empty texts: no words, no windows, not contaminated.  An item without an id still marks
documents; its id counts as the empty string.  Repeated items and ids count once.  An
empty table gives an empty result, an empty benchmark marks nothing.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .words import lower, pieces, texts_of

WINDOW = 10
BLOCK_WORDS = 500_000
_ROW = "decontam_row"

# Bytes beyond ASCII belong to words whole, so words can be cut in UTF-8.
_WORD_BYTES = {*range(48, 58), *range(97, 123), *range(128, 256)}
_NORMAL = bytes(b if b in _WORD_BYTES else 32 for b in lower(bytes(range(256))))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_OTHER = "￿"
# Symbols start here and jump over surrogates and the symbol of all other words.
_FIRST = 0x100
_UPPER = {i: i + 32 for i in range(65, 91)}


def _symbol(i: int) -> str:
    code = _FIRST + i
    return chr(code if code < 0xD800 else code + 0x2800)


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


class Windows:
    """All windows of a benchmark in one automaton."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.symbols: dict[bytes, str] = {}
        self.automaton = ahocorasick.Automaton()
        self.names: list[str] = []
        owners: dict[str, set[int]] = {}
        number: dict[str, int] = {}
        for name, text in items:
            words = normal_words(text)
            for w in words:
                if w not in self.symbols:
                    self.symbols[w] = _symbol(len(self.symbols))
            coded = "".join(map(self.symbols.__getitem__, words))
            size = min(window, len(coded))
            if size and name not in number:
                number[name] = len(self.names)
                self.names.append(name)
            for i in range(len(coded) - size + 1 if size else 0):
                owners.setdefault(coded[i:i + size], set()).add(number[name])
        for pattern, who in owners.items():
            self.automaton.add_word(pattern, (len(pattern), tuple(sorted(who))))
        if owners:
            self.automaton.make_automaton()
        self.any = bool(owners)

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], set[int]]:
        """Number of words, ranges of hit words (from, past the end), numbers of items."""
        words = normal_words(text)
        if not self.any or not words:
            return len(words), [], set()
        get = self.symbols.get
        coded = "".join([get(w, _OTHER) for w in words])
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        for last, (size, who) in self.automaton.iter(coded):
            start, end = last - size + 1, last + 1
            # Ends ascend; a longer window may reach back over several spans.
            while spans and start <= spans[-1][1]:
                start = min(start, spans.pop()[0])
            spans.append((start, end))
            items.update(who)
        return len(words), spans, items


def word_places(text: str) -> list[tuple[int, int]]:
    """Where each normalised word lies in the text as it came, in characters."""
    return [m.span() for m in _WORD.finditer(text.translate(_UPPER))]


def _blocks(
    benchmark: DataFrame, item_id: str, text: str, window: int, block_words: int, max_words: int | None = None
) -> Iterator[list[tuple[str, bytes]]]:
    """The benchmark's rows in blocks of at most `block_words` words; one block, if empty, at least."""
    items = benchmark.select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("name"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    n = items.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")))).first()[0] or 0
    if max_words is not None and n > max_words:
        raise ValueError(f"the benchmark has {n} words, more than {max_words}")
    if n <= block_words:
        yield [(r["name"], r["text"].encode()) for r in items.collect()]
        return
    size = max(block_words, window)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, used = TaskContext.get().partitionId() << 32, 0
        for batch in pieces(batches, "text"):
            blocks, names, texts = [], [], []
            for name, raw in zip(batch.column("name").to_pylist(), texts_of(batch)):
                words = normal_words(raw)
                for i in range(0, max(len(words) - window + 1, min(len(words), 1)), size - window + 1):
                    part = words[i:i + size]
                    if used + len(part) > size:
                        block, used = block + 1, 0
                    used += len(part)
                    blocks.append(block)
                    names.append(name)
                    texts.append(b" ".join(part).decode())
            yield pa.RecordBatch.from_arrays(
                [pa.array(blocks, pa.int64()), pa.array(names, pa.string()), pa.array(texts, pa.string())],
                ["block", "name", "text"],
            )

    parts = cut_lineage(items.coalesce(-(-n // size)).mapInArrow(cut, "block long, name string, text string"))
    for r in parts.select("block").distinct().orderBy("block").collect():
        rows = parts.filter(F.col("block") == r["block"]).select("name", "text").collect()
        yield [(x["name"], x["text"].encode()) for x in rows]


def _joined(ranges: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """The union of ranges of words (from, past the end) with their ranges of characters."""
    out: list[tuple[int, int, int, int]] = []
    for a, b, start, end in sorted(ranges):
        if out and a <= out[-1][1]:
            first, last, begin, stop = out.pop()
            a, start = first, begin
            b, end = max((b, end), (last, stop))
        out.append((a, b, start, end))
    return out


def find_overlap(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    max_words: int | None = None,
    spans: bool = True,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """One row per document: which of its words lie in windows of the benchmark.

    Columns: doc_id, n_words, n_hit, item_ids (sorted strings) and, if `spans`, hit_spans:
    ranges of characters of the original text, first and past the last.
    """
    if window < 1:
        raise ValueError(f"window must be positive, not {window}")
    blocks = _blocks(benchmark, item_id, item_text, window, block_words, max_words)
    rows, following = next(blocks), next(blocks, None)
    spark = docs.sparkSession
    fields = [
        T.StructField("doc_id", docs.schema[doc_id].dataType),
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("item_ids", T.ArrayType(T.StringType())),
    ]
    pair = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    if spans:
        fields.append(T.StructField("hit_spans", T.ArrayType(pair)))

    def result(ids: pa.Array, n_words: list[int], ranges: list[list], names: list[list[str]]) -> pa.RecordBatch:
        columns = [
            ids, pa.array(n_words, pa.int64()), pa.array([sum(r[1] - r[0] for r in x) for x in ranges], pa.int64()),
            pa.array(names, pa.list_(pa.string())),
        ]
        out = ["doc_id", "n_words", "n_hit", "item_ids"]
        if spans:
            places = [[{"start": r[2], "end": r[3]} for r in x] for x in ranges]
            columns.append(pa.array(places, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))))
            out.append("hit_spans")
        return pa.RecordBatch.from_arrays(columns, out)

    def found_in(batches: Iterator[pa.RecordBatch], rows: list[tuple[str, bytes]]) -> Iterator[tuple]:
        """Batches with each text's number of words, ranges and names of items."""
        found = Windows(rows, window)
        for batch in pieces(batches, "text"):
            n_words, ranges, names = [], [], []
            for raw in texts_of(batch):
                n, hit, who = found.scan(raw)
                at = word_places(raw.decode()) if hit and spans else None
                n_words.append(n)
                ranges.append([(a, b, *((at[a][0], at[b - 1][1]) if at else (0, 0))) for a, b in hit])
                names.append(sorted(found.names[i] for i in who))
            yield batch, n_words, ranges, names

    given = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    if following is None:
        shared = spark.sparkContext.broadcast(rows)

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, *found in found_in(batches, shared.value):
                yield result(batch.column("doc_id"), *found)

        return given.mapInArrow(search, T.StructType(fields))

    numbered = cut_lineage(given.withColumn(_ROW, F.monotonically_increasing_id()))

    def scanned(rows: list[tuple[str, bytes]], all_rows: bool) -> DataFrame:
        shared = spark.sparkContext.broadcast(rows)

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, n_words, ranges, names in found_in(batches, shared.value):
                out = pa.RecordBatch.from_arrays(
                    [
                        batch.column(_ROW), batch.column("doc_id"), pa.array(n_words, pa.int64()),
                        pa.array([[list(r) for r in x] for x in ranges], pa.list_(pa.list_(pa.int32()))),
                        pa.array(names, pa.list_(pa.string())),
                    ],
                    [_ROW, "doc_id", "n_words", "ranges", "names"],
                )
                yield out if all_rows else out.filter(pa.array([bool(x) for x in ranges], pa.bool_()))

        schema = T.StructType([
            T.StructField(_ROW, T.LongType()), *fields[:2],
            T.StructField("ranges", T.ArrayType(T.ArrayType(T.IntegerType()))),
            T.StructField("names", T.ArrayType(T.StringType())),
        ])
        out = cut_lineage(numbered.mapInArrow(search, schema))
        shared.destroy()
        return out

    first = scanned(rows, True)
    more = scanned(following, False)
    for rows in blocks:
        more = more.unionByName(scanned(rows, False))
    more = more.groupBy(_ROW).agg(
        F.flatten(F.collect_list("ranges")).alias("more_ranges"), F.flatten(F.collect_list("names")).alias("more_names")
    )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranges, names, more_ranges, more_names = (
                batch.column(c).to_pylist() for c in ("ranges", "names", "more_ranges", "more_names")
            )
            yield result(
                batch.column("doc_id"), batch.column("n_words").to_pylist(),
                [_joined([tuple(r) for r in a + (b or [])]) for a, b in zip(ranges, more_ranges)],
                [sorted({*a, *(b or [])}) for a, b in zip(names, more_names)],
            )

    return first.join(more, _ROW, "left").mapInArrow(merge, T.StructType(fields))


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """The documents, with all their columns, that hold no window of the benchmark.

    The text itself is scanned, so rows with equal or missing ids are judged one by one.  Columns
    of any name pass through unchanged; the private row number takes a name none of them has.
    """
    blocks = _blocks(benchmark, "item_id", "text", window, block_words)
    rows, following = next(blocks), next(blocks, None)
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(rows)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Windows(shared.value, window)
        for batch in pieces(batches, "text"):
            yield batch.filter(pa.array([not found.scan(t)[1] for t in texts_of(batch)], pa.bool_()))

    if following is None:
        return docs.mapInArrow(clean, docs.schema)
    # Row numbers of the first block's clean documents; later blocks name the rows that go.
    # The row number's name is unlike any column of the documents.
    row = _ROW
    while row.lower() in {c.lower() for c in docs.columns}:
        row += "_"
    numbered = cut_lineage(docs.mapInArrow(clean, docs.schema).withColumn(row, F.monotonically_increasing_id()))

    def hit_rows(rows: list[tuple[str, bytes]]) -> DataFrame:
        shared = context.broadcast(rows)

        def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = Windows(shared.value, window)
            for batch in pieces(batches, "text"):
                gone = pa.array([bool(found.scan(t)[1]) for t in texts_of(batch)], pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(row).filter(gone)], [row])

        out = cut_lineage(numbered.select(row, "text").mapInArrow(hits, f"{row} long"))
        shared.destroy()
        return out

    gone = hit_rows(following)
    for rows in blocks:
        gone = gone.unionByName(hit_rows(rows))
    return numbered.join(gone, row, "left_anti").select(*docs.columns)


def digest(item_ids: list[str]) -> str:
    return hashlib.sha256(",".join(item_ids).encode()).hexdigest()
