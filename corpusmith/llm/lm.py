"""Language-model scoring by deleted interpolation.

P(w | h) = a(b) c(h, w) / c(h, .) + u(b) c(w) / N + z(b) / (V + 1)

The maximum-likelihood estimates of pairs and of words and an equal share for each of the V known
tokens and one unknown are mixed by weights of the context's bucket b, the power of two of
c(h, .).  The weights come from expectation-maximisation on a fold of the training documents
whose own counts are taken off the estimates first (deleted), so they are learned on unseen text.

Counts cover every word and every pair of words of every training document; nothing is cut by
its share.  Every token is followed by one, so c(h, .) is the count of h.  Where c(h, .) is 0
the pair's weight is 0 and the others are raised to a sum of one, so probabilities add up to one.

Documents are written once in blocks of about `block_tokens` tokens.  A block asks once for each
of its different words and pairs; what it asks carries its own counts, so one shuffle both counts
and looks up.  Keys are dealt to slices by their first bits, and their number grows with the
corpus, so a slice stays bounded and a frequent key costs one entry a block.  The answers are
totals in the order of the keys and go back to the block by themselves.

Texts are lowered (A-Z), cut into words, and end with an end token that also stands before the
first word.  Words and pairs are told apart by 64-bit hashes.  The bits held out for scoring
are documents whose crc32 of the id as text leaves 0 by `folds`; fold 1 is the one EM learns on.
A null text is empty (an end token); a null id counts as the empty string, so it is
held out.  Repeated rows are counted and scored each.  Without training documents N and V are 0
and every token has probability 1.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .words import batch_hashes, lower, mix, pieces, texts_of

FOLDS = 10
TUNE_FOLD = 1
FREQUENT = 1e-6
BLOCK_TOKENS = 2_000_000
BUCKETS = 48
ROUNDS = 60
# Estimates go into the EM statistics in steps of a quarter of a power of two.
STEPS_PER_BIT = 4
LEVELS = 400
ADD = 0.1

END = mix(np.array([0x656E64], dtype=np.uint64))[0]
_PAIR = np.uint64(0x9E3779B97F4A7C15)
# Kinds of blocks: held out, learned on by EM, other training documents.
HELD, TUNED, OTHER = 0, 1, 2


def fold_of(doc_id: Column, folds: int = FOLDS) -> Column:
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds).cast("int")


def _tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes (words and an end for each text) and where each text's begin."""
    words, at = batch_hashes([lower(t) for t in texts_of(batch)])
    n = len(at) - 1
    return np.insert(words, at[1:], END), at + np.arange(n + 1)


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers by planes of bytes, compressed; small ones cost about a byte."""
    planes = np.ascontiguousarray(values.astype(np.uint64).view(np.uint8).reshape(-1, 8).T)
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], 8 * n, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view(np.uint64).ravel()


def _packed_keys(keys: np.ndarray) -> bytes:
    """Ascending keys by their differences."""
    return _packed(np.diff(keys, prepend=np.uint64(0)))


def _unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(data), dtype=np.uint64)


def _blocks(block_tokens: int, id_type: pa.DataType) -> callable:
    """Documents of one kind together: their ids, lengths, words and the words' numbers."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made = TaskContext.get().partitionId() << 32, 0
        ids, tokens, lengths = ([[] for _ in range(3)] for _ in range(3))
        size = [0, 0, 0]

        def out(kind: int) -> pa.RecordBatch:
            words, number, count = np.unique(np.concatenate(tokens[kind]), return_inverse=True, return_counts=True)
            # Frequent words get small numbers, which compress well.
            order = np.argsort(-count, kind="stable")
            place = np.empty_like(order)
            place[order] = np.arange(len(order))
            names = pa.chunked_array(ids[kind], type=id_type).combine_chunks()
            row = [
                pa.array([first + made]), pa.array([kind], pa.int32()), pa.array([-1], pa.int32()),
                pa.array([size[kind]]), pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names),
                pa.array([_packed(np.concatenate(lengths[kind]))], pa.binary()),
                pa.array([words[order].tobytes()], pa.binary()), pa.array([_packed(place[number])], pa.binary()),
            ]
            ids[kind], tokens[kind], lengths[kind], size[kind] = [], [], [], 0
            return pa.RecordBatch.from_arrays(
                row, ["block", "kind", "slice", "n_tokens", "doc_ids", "lengths", "words", "data"]
            )

        for batch in pieces(batches, "text"):
            hashes, at = _tokens(batch)
            length = np.diff(at)
            fold = batch.column("fold").to_numpy()
            kinds = np.where(fold == 0, HELD, np.where(fold == TUNE_FOLD, TUNED, OTHER))
            by_token = np.repeat(kinds, length)
            for kind in np.unique(kinds).tolist():
                mine = kinds == kind
                ids[kind].append(batch.column("doc_id").filter(pa.array(mine)))
                tokens[kind].append(hashes[by_token == kind])
                lengths[kind].append(length[mine])
                size[kind] += int(length[mine].sum())
                if size[kind] >= block_tokens:
                    yield out(kind)
                    made += 1
        for kind in (HELD, TUNED, OTHER):
            if size[kind]:
                yield out(kind)
                made += 1

    return rows


class Block:
    """A block's tokens, contexts and pairs as numbers among its ascending keys."""

    def __init__(self, lengths: bytes, words: bytes, data: bytes):
        hashes = np.frombuffer(words, dtype=np.uint64)
        order = np.argsort(hashes)
        self.words = hashes[order]
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        self.word = place[_unpacked(data).astype(np.int64)]
        length = _unpacked(lengths).astype(np.int64)
        self.starts = np.cumsum(length) - length
        self.lengths = length
        self.context = np.empty_like(self.word)
        self.context[1:] = self.word[:-1]
        self.context[self.starts] = np.searchsorted(self.words, END)
        keys = mix(self.words[self.context] * _PAIR + self.words[self.word])
        self.pairs, self.pair, self.pair_n = np.unique(keys, return_inverse=True, return_counts=True)

    def word_n(self) -> np.ndarray:
        return np.bincount(self.word, minlength=len(self.words))


def _ask(bits: int) -> callable:
    """Each block's words and pairs with its counts, cut into slices by the keys' first bits."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
        for batch in batches:
            for i in range(batch.num_rows):
                block, kind, *given = (batch.column(c)[i].as_py() for c in ("block", "kind", "lengths", "words", "data"))
                b = Block(*given)
                slices, keys, counts = [], [], []
                for base, key, n in ((0, b.words, b.word_n()), (1 << bits, b.pairs, b.pair_n)):
                    at = np.append(np.searchsorted(key, edges), len(key))
                    for s in np.flatnonzero(np.diff(at)).tolist():
                        slices.append(base + s)
                        keys.append(_packed_keys(key[at[s]:at[s + 1]]))
                        counts.append(_packed(n[at[s]:at[s + 1]]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(slices, pa.int32()), pa.array([block] * len(slices), pa.int64()),
                        pa.array([kind] * len(slices), pa.int32()), pa.array(keys, pa.binary()), pa.array(counts, pa.binary()),
                    ],
                    ["slice", "block", "kind", "keys", "counts"],
                )

    return rows


def _groups(batches: Iterator[pa.RecordBatch], key: str, names: list[str]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows that follow each other and have one key, as tuples of the named columns."""
    last, rows = None, []
    for batch in batches:
        columns = [batch.column(c) for c in names]
        for i, k in enumerate(batch.column(key).to_pylist()):
            if rows and k != last:
                yield last, rows
                rows = []
            last = k
            rows.append(tuple(c[i] for c in columns))
    if rows:
        yield last, rows


def _answer(bits: int) -> callable:
    """For what each block asked: totals of training and, for those EM learns on, of their fold."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, asked in _groups(batches, "slice", ["block", "kind", "keys", "counts"]):
            asked = [tuple(x.as_py() for x in r) for r in asked]
            keys = [_unpacked_keys(r[2]) for r in asked]
            size = np.array([len(k) for k in keys])
            counts = np.concatenate([_unpacked(r[3]) for r in asked]).astype(np.int64)
            kind = np.repeat(np.array([r[1] for r in asked]), size)
            known, which = np.unique(np.concatenate(keys), return_inverse=True)
            n, m = np.zeros(len(known), dtype=np.int64), np.zeros(len(known), dtype=np.int64)
            np.add.at(n, which[kind != HELD], counts[kind != HELD])
            np.add.at(m, which[kind == TUNED], counts[kind == TUNED])
            data, end = [], 0
            for r, k in zip(asked, size.tolist()):
                mine = which[end:end + k]
                end += k
                data.append(_packed(np.concatenate([n[mine], m[mine]]) if r[1] == TUNED else n[mine]))
            kinds = [0] * len(asked)
            if s < 1 << bits:
                kinds[0] = int((n > 0).sum())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in asked], pa.int64()), pa.array([r[1] for r in asked], pa.int32()),
                    pa.array([s] * len(asked), pa.int32()), pa.array(data, pa.binary()), pa.array(kinds, pa.int64()),
                ],
                ["block", "kind", "slice", "data", "kinds"],
            )

    return rows


def _with_totals(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[tuple]:
    """Every block with its ids, kind and totals: of words, of pairs, and both of the tuning fold."""
    for _, rows in _groups(batches, "block", ["slice", "kind", "doc_ids", "lengths", "words", "data"]):
        (_, kind, ids, *given), *answers = rows
        block, kind = Block(*(g.as_py() for g in given)), kind.as_py()
        totals = {True: ([], []), False: ([], [])}
        for r in answers:
            n = _unpacked(r[5].as_py()).astype(np.int64)
            half = len(n) // 2 if kind == TUNED else len(n)
            part = totals[r[0].as_py() < 1 << bits]
            part[0].append(n[:half])
            part[1].append(n[half:])
        word_n, word_m, pair_n, pair_m = (np.concatenate(x) for first in (True, False) for x in totals[first])
        if len(word_n) != len(block.words) or len(pair_n) != len(block.pairs):
            raise ValueError("a block did not get an answer to each of its keys")
        yield block, kind, ids.values, word_n, word_m, pair_n, pair_m


def _bucket(c: np.ndarray) -> np.ndarray:
    """0 for a context never seen, else one more than the power of two."""
    out = np.zeros(len(c), dtype=np.int64)
    some = c > 0
    out[some] = np.minimum(1 + np.log2(c[some]).astype(np.int64), BUCKETS - 1)
    return out


def _level(p: np.ndarray) -> np.ndarray:
    """A probability as a step of its logarithm, LEVELS for none."""
    out = np.full(len(p), LEVELS, dtype=np.int64)
    some = p > 0
    out[some] = np.minimum(np.round(-np.log2(p[some]) * STEPS_PER_BIT), LEVELS - 1).astype(np.int64)
    return out


def _estimate(level: np.ndarray) -> np.ndarray:
    return np.where(level == LEVELS, 0.0, 2.0 ** (-level / STEPS_PER_BIT))


def _tuning_rows(bits: int, left: int) -> callable:
    """Events of the tuning fold by bucket and estimates, its own counts taken off."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, _, word_n, word_m, pair_n, pair_m in _with_totals(batches, bits):
            word, pair = word_n - word_m, pair_n - pair_m
            after = word[block.context]
            two = _level(pair[block.pair] / np.maximum(after, 1))
            one = _level(word / max(left, 1))[block.word]
            cells = (_bucket(word)[block.context] * (LEVELS + 1) + two) * (LEVELS + 1) + one
            kinds, n = np.unique(cells, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(n)], ["cell", "n"])

    return rows


def learn_weights(cells: list[tuple[int, int]], kinds: int) -> np.ndarray:
    """Mixture weights of every bucket by EM over (cell, count) statistics.

    A bucket with few events leans on the weights of all buckets together.
    """
    default = np.tile([0.5, 0.4, 0.1], (BUCKETS, 1))
    if not cells:
        return default
    cell = np.array([c[0] for c in cells], dtype=np.int64)
    n = np.array([c[1] for c in cells], dtype=float)
    part = LEVELS + 1
    bucket = cell // (part * part)
    p = np.stack([_estimate(cell // part % part), _estimate(cell % part), np.full(len(cell), 1 / (kinds + 1))], axis=1)

    def em(start: np.ndarray, group: np.ndarray, prior: np.ndarray) -> np.ndarray:
        w = start.copy()
        for _ in range(ROUNDS):
            share = w[group] * p
            share *= (n / share.sum(axis=1))[:, None]
            got = np.stack([np.bincount(group, weights=share[:, i], minlength=len(w)) for i in range(3)], axis=1) + prior
            w = got / got.sum(axis=1, keepdims=True)
        return w

    pooled = em(default[:1], np.zeros(len(cell), dtype=np.int64), np.full((1, 3), 1e-3))
    return em(np.repeat(pooled, BUCKETS, axis=0), bucket, np.repeat(100 * pooled, BUCKETS, axis=0))


def usable_weights(weights: np.ndarray, total: int) -> np.ndarray:
    """The weights without those of estimates that do not exist, raised to a sum of one."""
    out = weights.copy()
    out[0, 0] = 0
    if not total:
        out[:, :2] = 0
    return out / out.sum(axis=1, keepdims=True)


def _score_rows(bits: int, weights: np.ndarray, total: int, kinds: int) -> callable:
    """One row per document: sums over its tokens."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, kind, ids, word_n, _, pair_n, _ in _with_totals(batches, bits):
            w = weights[_bucket(word_n)[block.context]]
            p = w[:, 0] * pair_n[block.pair] / np.maximum(word_n[block.context], 1)
            p += w[:, 1] * (word_n / max(total, 1))[block.word] + w[:, 2] / (kinds + 1)
            base = np.log10((word_n + ADD) / (total + ADD * (kinds + 1)))
            sums = [
                np.add.reduceat(x, block.starts)
                for x in ((word_n > 0)[block.word].astype(np.int64), base[block.word], np.log10(p))
            ]
            n = len(block.lengths)
            for i in range(0, n, 10_000):
                part = slice(i, i + 10_000)
                size = len(block.lengths[part])
                yield pa.RecordBatch.from_arrays(
                    [
                        ids[part], pa.array(np.full(size, kind == HELD)), pa.array(block.lengths[part]),
                        pa.array(sums[0][part]), pa.array(np.full(size, total, dtype=np.int64)),
                        pa.array(sums[1][part]), pa.array(sums[2][part]),
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return rows


def score_documents(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", frequent: float = FREQUENT,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """One row per document: its log10 probability under the model and under the base.

    Columns: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.
    `frequent` is taken for older callers: no word or pair is treated by its share any more.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), fold_of(F.col(doc_id)).alias("fold"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    sample = rows.select("doc_id").limit(0).toArrow().schema.field("doc_id").type
    blocks = cut_lineage(rows.mapInArrow(
        _blocks(block_tokens, sample),
        f"block long, kind int, slice int, n_tokens long, doc_ids array<{id_type}>, lengths binary, words binary, data binary",
    ))
    of_kind = {r["kind"]: r["n"] for r in blocks.groupBy("kind").agg(F.sum("n_tokens").alias("n")).collect()}
    tuned = of_kind.get(TUNED, 0)
    total = tuned + of_kind.get(OTHER, 0)
    # Slices hold about a block's tokens each, however large the corpus is.
    bits = max(1, math.ceil(math.log2(max(1, sum(of_kind.values()) / block_tokens))))
    answers = cut_lineage(
        blocks.mapInArrow(_ask(bits), "slice int, block long, kind int, keys binary, counts binary")
        .repartition("slice").sortWithinPartitions("slice")
        .mapInArrow(_answer(bits), "block long, kind int, slice int, data binary, kinds long")
    )
    kinds = answers.agg(F.sum("kinds")).first()[0] or 0
    given = blocks.drop("n_tokens").unionByName(answers.drop("kinds"), allowMissingColumns=True)

    def together(part: DataFrame) -> DataFrame:
        return part.repartition("block").sortWithinPartitions("block", "slice")

    cells = (
        together(given.filter(F.col("kind") == TUNED)).mapInArrow(_tuning_rows(bits, total - tuned), "cell long, n long")
        .groupBy("cell").agg(F.sum("n").alias("n")).collect()
    )
    weights = usable_weights(learn_weights([(r["cell"], r["n"]) for r in cells], kinds), total)
    return together(given).mapInArrow(
        _score_rows(bits, weights, total, kinds),
        f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )


def perplexity(score: float, tokens: int) -> float:
    return math.pow(10, -score / max(tokens, 1))
