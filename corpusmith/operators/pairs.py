"""Similarity join by threshold: every pair of vectors at least so similar, each pair once.

Rows are put in groups, and only rows of groups that can hold a pair meet.  For cosine and
euclidean, m pivot vectors are drawn (the smallest hashes of the ids); every vector gets its
band of distance to each pivot, band = floor(distance / r), r the radius the threshold allows.
By the triangle inequality two vectors within r of each other lie in bands at most one apart for
every pivot, so a group is a band tuple and meets the 3^m tuples next to it.  For the dot
product, Cauchy-Schwarz bounds a pair by the product of norms: a group is a bucket of norms by
powers of two, and only bucket pairs whose largest norms could reach the threshold meet.

A group is cut into blocks of at most BLOCK_ROWS rows.  A cell holds one block and streams the
rows that may be similar to it from a sorted shuffle, sifted by a matrix product with room for
its rounding; the pairs that pass are scored exactly, in double precision and in the order of
the entries.  Within one table a pair of groups or of blocks meets in one of its two cells only.
Where the groups do not part the vectors, the work stays quadratic: that is an exact join.

Rows with a NULL vector, a NULL entry, a NULL id or, for cosine, a zero vector take no part, and
vectors of unlike sizes are no pair.  The vectors are read once and written; the pivots (m
vectors) go to the driver.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors as V
from ..session import broadcast_if_small, cut_lineage

PIVOTS = 3
# Rows a cell holds, at most; its products hold BLOCK_CELLS numbers, its exact scores PAIRS pairs at once.
BLOCK_ROWS = 32768
BLOCK_CELLS = 1 << 22
PAIRS = 1 << 14
# Groups whose sizes may be broadcast.
MOST_GROUPS = 100_000


def _prepared(df: DataFrame, id_col: str, vector: str, method: str) -> DataFrame:
    """id, raw (the vector), v (of length one for cosine) and a row number, written once."""
    kind = df.schema[vector].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    raw = F.col(vector) if single else F.col(vector).cast("array<double>")
    rows = df.select(F.col(id_col).alias("id"), raw.alias("raw")).filter(
        F.col("id").isNotNull() & F.col("raw").isNotNull() & F.forall("raw", lambda x: x.isNotNull())
    )
    if method == "cosine":
        rows = rows.filter(V.norm("raw") > 0)
    rows = cut_lineage(rows.withColumn("row", F.monotonically_increasing_id()))
    v = F.col("raw").cast("array<double>")
    return rows.withColumn("v", V.normalize("raw") if method == "cosine" else v)


def similar_pairs(
    left: DataFrame,
    right: DataFrame | None = None,
    threshold: float = 0.8,
    method: str = "cosine",
    left_id: str = "vec_id",
    right_id: str = "vec_id",
    vector: str = "embedding",
    pivots: int = PIVOTS,
) -> DataFrame:
    """left_id, right_id, score of every pair whose score is at least `threshold`.

    Without `right`, the table is joined with itself and each unordered pair of different ids
    comes once, with left_id < right_id.  `euclidean` scores are negative distances, as in
    `functions.vectors`, so a threshold of -r keeps pairs within r.
    """
    V.check_method(method)
    itself = right is None
    a = _prepared(left, left_id, vector, method)
    b = a if itself else _prepared(right, right_id, vector, method)
    if method == "dot":
        own, moved = _by_norms(a, b, threshold, itself)
    else:
        # A little wider than the threshold allows: distances are rounded.
        radius = math.sqrt(max(0.0, 2.0 - 2.0 * threshold)) + 1e-7 if method == "cosine" else -threshold
        if radius < 0:
            return left.sparkSession.createDataFrame([], "left_id long, right_id long, score double")
        own, moved = _by_rings(a, b, radius * (1 + 1e-6), pivots, itself)
    pairs = _met(own, moved, threshold, method, itself)
    if not itself:
        return pairs.select(F.col("a_id").alias("left_id"), F.col("b_id").alias("right_id"), "score")
    return pairs.filter(F.col("a_id") != F.col("b_id")).select(
        F.least("a_id", "b_id").alias("left_id"), F.greatest("a_id", "b_id").alias("right_id"), "score"
    )


def _by_rings(a: DataFrame, b: DataFrame, radius: float, m: int, itself: bool) -> tuple[DataFrame, DataFrame]:
    """Rows of a with their group, rows of b with the groups they meet: bands at most one apart.

    `same` marks the row's own group; of two groups of one table that are next to each other,
    the rows of the one with the larger tuple go to the other.
    """
    chosen = a.orderBy(F.xxhash64("id"), "id").limit(m).select("v").collect()
    bands = []
    for p in (r["v"] for r in chosen):
        centre = F.array(*[F.lit(float(x)) for x in p])
        # Vectors of another size than the pivot have no distance to it: one band for all.
        band = F.floor(F.sqrt(V.squared_l2("v", centre)) / F.lit(radius)) if radius else F.lit(0)
        bands.append(F.coalesce(band.cast("long"), F.lit(0).cast("long")))
    size = F.size("raw").cast("long")
    if not radius:
        # Equal vectors only.
        bands = [F.xxhash64("v")]
    own = a.select("row", "id", "raw", F.array(size, *bands).alias("k"))
    near = [s for s in itertools.product((-1, 0, 1), repeat=len(bands) if radius else 0)]
    if itself:
        near = [s for s in near if s <= tuple(0 for _ in s)]
    if not radius:
        near = [(0,)]
    key = lambda s: F.array(F.col("own")[0], *[F.col("own")[i + 1] + F.lit(d).cast("long") for i, d in enumerate(s)])
    moved = b.select("row", "id", "raw", F.array(size, *bands).alias("own")).select(
        "row", "id", "raw", "own", F.explode(F.array(*[key(s) for s in near])).alias("k")
    )
    return own, moved.withColumn("same", F.col("k") == F.col("own")).drop("own")


def _by_norms(a: DataFrame, b: DataFrame, threshold: float, itself: bool) -> tuple[DataFrame, DataFrame]:
    """The same with buckets of norms: those meet whose largest norms could reach the threshold."""
    bucket = F.floor(F.log2(F.greatest(V.norm("raw"), F.lit(1e-300)))).cast("long")
    size = F.size("raw").cast("long")
    a = a.select("row", "id", "raw", F.array(size, bucket).alias("k"))
    b = b.select("row", "id", "raw", F.array(size, bucket).alias("own"))
    found = sorted({r[0] for df, c in ((a, "k"), (b, "own")) for r in df.select(F.col(c)[1]).distinct().collect()})
    # One row per pair of buckets that occur: at most about 2100 of each, by the range of doubles.
    ok = [(i, j) for i in found for j in found if threshold <= 0 or 2.0 ** (i + 1) * 2.0 ** (j + 1) >= threshold]
    if itself:
        ok = [(i, j) for i, j in ok if i <= j]
    table = F.broadcast(a.sparkSession.createDataFrame(ok or [(0, 0)], "i long, j long").filter(F.lit(bool(ok))))
    moved = b.join(table, F.col("own")[1] == F.col("j")).select(
        "row", "id", "raw", F.array(F.col("own")[0], F.col("i")).alias("k"), (F.col("i") == F.col("j")).alias("same")
    )
    return a, moved


def _met(own: DataFrame, moved: DataFrame, threshold: float, method: str, itself: bool) -> DataFrame:
    """a_id, b_id, score of the pairs that reach the threshold, from rows in cells."""
    cores = own.sparkSession.sparkContext.defaultParallelism
    counted = cut_lineage(own.groupBy("k").count())
    n = counted.agg(F.sum("count")).first()[0] or 0
    block_rows = max(1, min(BLOCK_ROWS, -(-n // (4 * cores))))
    groups = broadcast_if_small(
        counted.select("k", F.ceil(F.col("count") / F.lit(block_rows)).cast("long").alias("blocks")), MOST_GROUPS
    )
    block = F.pmod(F.xxhash64("row"), F.col("blocks"))
    kind = moved.schema["id"].dataType
    none = F.lit(False)
    held = own.join(groups, "k").select("k", block.alias("block"), none.alias("asks"), none.alias("diagonal"), "row", "id", "raw")
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    if itself:
        # Of two blocks of one group the rows of one go to the other, by turns, so all send about half.
        mine = lambda i: (i == F.col("b")) | ((i < F.col("b")) == ((i + F.col("b")) % 2 == 0))
        every = F.when(F.col("same"), F.filter(every, mine)).otherwise(every)
    asking = (
        moved.join(groups, "k").withColumn("b", block)
        .select("k", F.explode(every).alias("block"), "same", "b", "row", "id", "raw")
        .select(
            "k", "block", F.lit(True).alias("asks"),
            (F.lit(itself) & F.col("same") & (F.col("block") == F.col("b"))).alias("diagonal"), "row", "id", "raw",
        )
    )
    # Rows of unlike id types stay apart: each side has a column of its own.
    mixed = held.withColumns({"a_id": F.col("id"), "b_id": F.lit(None).cast(kind)}).drop("id").unionByName(
        asking.withColumns({"a_id": F.lit(None).cast(own.schema["id"].dataType), "b_id": F.col("id")}).drop("id")
    )
    cells = -(-n // block_rows)
    mixed = (
        mixed.withColumn("cell", F.concat_ws(",", F.col("k").cast("array<string>"), F.col("block").cast("string")))
        .drop("k", "block").repartition(max(cores, min(4 * cells, 400)), "cell").sortWithinPartitions("cell", "asks")
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, pending, block = None, [], None
        for name, asks, run in _runs(batches):
            if name != cell:
                cell, pending, block = name, [], None
            if not asks:
                pending.append(run)
                continue
            if pending:
                block, pending = _Block(pa.Table.from_batches(pending), threshold, method), []
            if block is not None:
                yield from block.pairs(run)

    schema = T.StructType([
        T.StructField("a_id", own.schema["id"].dataType), T.StructField("b_id", kind), T.StructField("score", T.DoubleType()),
    ])
    return mixed.mapInArrow(search, schema)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bool, pa.RecordBatch]]:
    """Pieces of sorted batches with one cell and one side each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        cell = batch.column("cell").to_numpy(zero_copy_only=False)
        asks = batch.column("asks").to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((cell[1:] != cell[:-1]) | (asks[1:] != asks[:-1])) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        for start, end in zip(edges, edges[1:]):
            yield cell[start], bool(asks[start]), batch.slice(start, end - start)


def _matrix(lists: pa.Array) -> np.ndarray:
    """Vectors of one size, without NULL entries, as rows of a matrix."""
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), len(flat) // len(lists))


def _sum(terms: np.ndarray) -> np.ndarray:
    """Sums of rows, entry by entry in their order, as the column functions add them."""
    return np.cumsum(terms, axis=1)[:, -1] if terms.shape[1] else np.zeros(len(terms))


class _Block:
    """The rows of one block: finds which rows of a batch are similar to which of them."""

    def __init__(self, table: pa.Table, threshold: float, method: str):
        self.threshold, self.method = threshold, method
        table = table.combine_chunks()
        self.ids = pa.concat_arrays(table.column("a_id").chunks)
        self.row = table.column("row").to_numpy()
        self.matrix = _matrix(pa.concat_arrays(table.column("raw").chunks))
        self.left, self.size = self._side(self.matrix)

    def _side(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows as the sifting product takes them, and their lengths."""
        rows = rows.astype(np.float64)
        size = np.sqrt(np.einsum("ij,ij->i", rows, rows))
        if self.method == "cosine":
            return (rows / size[:, None]).astype(np.float32), np.ones(len(rows))
        return rows, size

    def pairs(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        step = max(1, BLOCK_CELLS // len(self.matrix))
        for start in range(0, batch.num_rows, step):
            yield from self._pairs(batch.slice(start, step))

    def _pairs(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows, row = _matrix(batch.column("raw")), batch.column("row").to_numpy()
        diagonal = batch.column("diagonal").to_numpy(zero_copy_only=False)
        with np.errstate(all="ignore"):
            found = np.flatnonzero(self._sift(rows))
        for start in range(0, len(found), PAIRS):
            a, b = np.divmod(found[start : start + PAIRS], len(rows))
            once = ~diagonal[b] | (self.row[a] < row[b])
            a, b = a[once], b[once]
            with np.errstate(all="ignore"):
                score = self._exact(self.matrix[a].astype(np.float64), rows[b].astype(np.float64))
            # As in the column functions, NaN is above every threshold.
            keep = (score >= self.threshold) | np.isnan(score)
            if keep.any():
                yield pa.RecordBatch.from_arrays(
                    [self.ids.take(pa.array(a[keep])), batch.column("b_id").take(pa.array(b[keep])), pa.array(score[keep])],
                    names=["a_id", "b_id", "score"],
                )

    def _sift(self, rows: np.ndarray) -> np.ndarray:
        """Pairs that may reach the threshold: the product with room for its rounding; NaN passes."""
        right, size = self._side(rows)
        unit = 2.0**-24 if self.method == "cosine" else 2.0**-53
        room = 8 * (rows.shape[1] + 8) * unit
        near, least = self.left @ right.T, self.threshold
        if self.method == "euclidean":
            near = 2.0 * near - (self.size * self.size)[:, None] - size * size
            least = -self.threshold * self.threshold
            room = room * ((self.size + size.max()) ** 2 + abs(least))[:, None]
        elif self.method == "dot":
            room = room * (self.size * size.max())[:, None]
        else:
            # In the product's own precision, so that the comparison makes no copy of it.
            return ~(near < np.float32(least - room - 1e-6))
        return ~(near < least - room)

    def _exact(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if self.method == "euclidean":
            return -np.sqrt(_sum((a - b) * (a - b)))
        value = _sum(a * b)
        if self.method == "cosine":
            size = np.sqrt(_sum(a * a)) * np.sqrt(_sum(b * b))
            # Lengths whose product is too small for a double have no cosine.
            value = np.divide(value, size, out=np.full(len(value), -np.inf), where=size != 0)
        return value
