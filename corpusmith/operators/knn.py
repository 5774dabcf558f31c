"""Exact nearest neighbours: a table of queries against a table of vectors.

Few queries (their size is checked) travel to every executor, the vectors are read
once where they lie, and each task keeps the k best per query; only those rows are
shuffled.  More queries than that are cut, together with the vectors, into a grid of
cells.  A cell holds a bounded block of queries and streams its share of the vectors,
so no task ever holds a whole side and nothing but k rows per query leaves it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import check_method, same_size, squared_l2
from ..session import cut_lineage

INDEX_METHOD = "l2"
# Order among neighbours is by the value rounded to this many digits, then by id.
DIGITS = 9
# Query vectors a task holds, as doubles, broadcast or as a block of the grid: its memory does
# not grow with the number of queries.
BROADCAST_BYTES = 8 << 20
BLOCK_QUERIES = 16384
# Vectors one cell of the grid streams, roughly at most.
SLICE_ROWS = 1 << 22
# Cells of a product of queries and vectors held at once in a task.
BLOCK_CELLS = 1 << 22
# Entries of chosen pairs computed exactly at once.
EXACT_CELLS = 1 << 20
UNUSABLE = "a vector has an entry that is NULL, NaN, infinite or too large"


def nearest(
    queries: DataFrame,
    vectors: DataFrame,
    k: int = 5,
    method: str = INDEX_METHOD,
    query_id: str = "query_id",
    vector_id: str = "vec_id",
    query_vector: str = "embedding",
    vector: str = "embedding",
    broadcast_bytes: int = BROADCAST_BYTES,
    block_queries: int = BLOCK_QUERIES,
    cells: int | None = None,
) -> DataFrame:
    """The k nearest vectors of every query, ranked from 1.

    method 'l2' is the index's own: column `distance`, squared, ascending.  The others
    give `score`, bigger is closer; an undefined cosine is NULL and comes last.  Vectors
    are arrays or packed; in one call both sides have the same form.
    A NULL vector has no neighbours and is none; a vector of another dimension, with a
    NULL, NaN or infinite entry, or too long to be squared is an error.
    Columns: query_id, rank, vector_id and distance or score.
    """
    if k < 1:
        raise ValueError(f"k must be positive, not {k}")
    if method != INDEX_METHOD:
        check_method(method)
    # Rows without a vector are dropped inside the tasks: a filter on the vector would
    # run the embedder it may come from a second time.  Queries are measured and then
    # read, so they are written once.
    q = cut_lineage(queries.select(F.col(query_id).alias("q_id"), F.col(query_vector).alias("v")))
    x = vectors.select(F.col(vector_id).alias("x_id"), F.col(vector).alias("v"))
    count, held = _measured(q)
    if held <= broadcast_bytes:
        best = _against_all(q, x, q.toArrow(), k, method)
    else:
        blocks = max(1, -(-count // block_queries), -(-held // BROADCAST_BYTES))
        best = _grid(q, x, k, method, blocks, cells)
    window = Window.partitionBy("q_id").orderBy("key", "x_id")
    value = (
        F.col("key").alias("distance")
        if method == INDEX_METHOD
        # Zero minus the key: no negative zero, and infinity stands for undefined.
        else F.when(~F.col("key").isin(float("inf")), F.lit(0.0) - F.col("key")).alias("score")
    )
    return (
        best.withColumn("rank", F.row_number().over(window))
        .filter(F.col("rank") <= k)
        .select(
            F.col("q_id").alias(query_id), "rank", F.col("x_id").alias(vector_id), value
        )
    )


def nearest_to_one(
    vectors: DataFrame,
    query: list[float],
    k: int = 5,
    vector_id: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """The k nearest vectors of one given vector, as a plain ordered limit.

    NULL vectors and vectors that cannot be compared are treated as by `nearest`.
    """
    given = [float(v) for v in query]
    if not all(map(math.isfinite, given)):
        raise ValueError(UNUSABLE)
    distance = same_size(vector, F.lit(given), squared_l2(vector, F.lit(given)))
    usable = F.coalesce(distance < float("inf"), F.lit(False))
    return (
        vectors.filter(F.col(vector).isNotNull())
        .select(
            F.col(vector_id),
            F.when(usable, F.round(distance, DIGITS)).otherwise(F.raise_error(UNUSABLE)).alias("distance"),
        )
        .orderBy("distance", vector_id)
        .limit(k)
    )


def _measured(q: DataFrame) -> tuple[int, int]:
    """The number of queries and the bytes of their vectors as doubles, by the widest."""
    packed = isinstance(q.schema["v"].dataType, T.BinaryType)
    width = F.octet_length("v") / 4 if packed else F.size("v")
    size = q.agg(F.count("*").alias("n"), F.max(width).alias("width")).first()
    return size["n"], int(size["n"] * (size["width"] or 1) * 8)


def _best_schema(q: DataFrame, x: DataFrame) -> T.StructType:
    return T.StructType(
        [
            T.StructField("q_id", q.schema["q_id"].dataType),
            T.StructField("x_id", x.schema["x_id"].dataType),
            T.StructField("key", T.DoubleType()),
        ]
    )


def _against_all(
    q: DataFrame, x: DataFrame, small: pa.Table, k: int, method: str
) -> DataFrame:
    shared = q.sparkSession.sparkContext.broadcast(small)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        best = _Best.of([table], k, method)
        if best is None:
            return
        for batch in batches:
            best.add(batch)
        yield from best.rows()

    # Each task of the vectors, as they are split upstream, sends k rows per query; the queries
    # are few on this path (their size is checked), so those rows stay small beside the vectors.
    return x.mapInArrow(search, _best_schema(q, x))


def _grid(
    q: DataFrame, x: DataFrame, k: int, method: str, blocks: int, cells: int | None
) -> DataFrame:
    """Queries in blocks times vectors in slices; every pair meets in exactly one cell."""
    spark = q.sparkSession
    wanted = cells or 4 * spark.sparkContext.defaultParallelism
    slices = max(1, -(-wanted // blocks), -(-x.count() // SLICE_ROWS))
    q_side = q.select(
        F.pmod(F.xxhash64("q_id"), F.lit(blocks)).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"),
        F.lit(0).alias("side"), "q_id", F.lit(None).cast(x.schema["x_id"].dataType).alias("x_id"), "v",
    )
    x_side = x.select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
        F.pmod(F.xxhash64("x_id"), F.lit(slices)).cast("int").alias("slice"),
        F.lit(1).alias("side"), F.lit(None).cast(q.schema["q_id"].dataType).alias("q_id"), "x_id", "v",
    )
    both = (
        q_side.unionByName(x_side)
        .withColumn("cell", F.col("block") * slices + F.col("slice"))
        .select("cell", "side", "q_id", "x_id", "v")
        .repartition(blocks * slices, "cell")
        .sortWithinPartitions("cell", "side")
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, pending, best = None, [], None
        for run_cell, side, run in _runs(batches):
            if run_cell != cell:
                if best is not None:
                    yield from best.rows()
                cell, pending, best = run_cell, [], None
            if side == 0:
                pending.append(pa.Table.from_batches([run]))
                continue
            if best is None:
                best, pending = _Best.of(pending, k, method), []
            if best is not None:
                best.add(run)
        if best is not None:
            yield from best.rows()

    return both.mapInArrow(search, _best_schema(q, x))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """Pieces of sorted batches with one cell and one side each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        cell = batch.column("cell").to_numpy()
        side = batch.column("side").to_numpy()
        cuts = np.flatnonzero((np.diff(cell) != 0) | (np.diff(side) != 0)) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        for start, end in zip(edges, edges[1:]):
            yield int(cell[start]), int(side[start]), batch.slice(start, end - start)


def _column(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name).combine_chunks()
    return pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column


def _matrix(lists: pa.Array) -> np.ndarray:
    """Vectors of one size, lists or packed, as rows of a matrix."""
    if pa.types.is_binary(lists.type):
        return _packed_matrix(lists)
    sizes = pc.list_value_length(lists)
    bounds = pc.min_max(sizes)
    if bounds["min"].as_py() != bounds["max"].as_py():
        raise ValueError(f"vectors differ in dimension: {bounds.as_py()}")
    flat = lists.flatten()
    if flat.null_count:
        raise ValueError("a vector has a NULL entry")
    return flat.to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _packed_matrix(values: pa.Array) -> np.ndarray:
    bounds = pc.min_max(pc.binary_length(values))
    width = bounds["max"].as_py()
    if bounds["min"].as_py() != width or width % 4:
        raise ValueError(f"packed vectors differ in dimension: {bounds.as_py()}")
    _, offsets, data = values.buffers()
    start = int(np.frombuffer(offsets, dtype=np.int32)[values.offset])
    count = len(values) * (width // 4)
    return np.frombuffer(data, np.float32, count, start).reshape(len(values), width // 4)


def _squares(rows: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", rows, rows, dtype=np.float64)


def _finite(squares: np.ndarray) -> np.ndarray:
    """One bad entry would make every comparison of its block false."""
    if not np.isfinite(squares).all():
        raise ValueError(UNUSABLE)
    return squares


class _Best:
    """The k best rows per query seen so far; never more than k per query kept.

    A block of rows is first sifted by a matrix product in the rows' own precision, with
    room for its rounding errors; the few pairs that pass are computed exactly.
    """

    def __init__(self, ids: pa.Array, matrix: np.ndarray, k: int, method: str):
        self.ids, self.k, self.method = ids, k, method
        self.matrix = matrix
        self.squares = _finite(_squares(matrix))
        self.length = np.sqrt(self.squares)
        self.left32 = self._left(np.float32)
        # In double precision only where rows ask for it.
        self.left64: np.ndarray | None = None
        self.bound = np.full(len(matrix), np.inf)
        self.kept: pa.Table | None = None

    def _left(self, kind: type) -> np.ndarray:
        """The queries as the sifting product takes them."""
        factor = np.ones(len(self.matrix))
        if self.method == "cosine":
            factor = np.divide(1.0, self.length, out=factor, where=self.length > 0)
        elif self.method != "dot":
            factor *= 2.0
        # One more column adds the squares of the rows inside the product.
        extra = self.method in (INDEX_METHOD, "euclidean")
        left = np.ones((len(self.matrix), self.matrix.shape[1] + extra), dtype=kind)
        step = max(1, EXACT_CELLS // max(1, self.matrix.shape[1]))
        with np.errstate(over="ignore"):
            for start in range(0, len(left), step):
                rows = slice(start, start + step)
                left[rows, : self.matrix.shape[1]] = -factor[rows, None] * self.matrix[rows].astype(np.float64)
        return left

    @classmethod
    def of(cls, tables: list[pa.Table], k: int, method: str) -> _Best | None:
        """For the queries that have a vector; None where there are none."""
        if not tables:
            return None
        table = pa.concat_tables(tables)
        table = table.filter(pc.is_valid(table.column("v")))
        if not table.num_rows:
            return None
        return cls(_column(table, "q_id"), _matrix(_column(table, "v")), k, method)

    def add(self, batch: pa.RecordBatch) -> None:
        if batch.column("v").null_count:
            batch = batch.filter(pc.is_valid(batch.column("v")))
        if not batch.num_rows:
            return
        ids, rows = batch.column("x_id"), _matrix(batch.column("v"))
        if rows.shape[1] != self.matrix.shape[1]:
            raise ValueError(
                f"query dimension {self.matrix.shape[1]} does not match {rows.shape[1]}"
            )
        ids, rows = _thin_copies(ids, rows, self.k)
        step = max(1, BLOCK_CELLS // len(self.matrix))
        for start in range(0, len(rows), step):
            self._add_block(ids.slice(start, step), rows[start : start + step])

    def _add_block(self, ids: pa.Array, rows: np.ndarray) -> None:
        near, own, room = self._sift(rows)
        limit = self._near(self.bound) - own + room
        passed = near <= limit[:, None]
        if len(rows) > self.k and np.count_nonzero(passed) > 8 * self.k * len(near):
            # Nothing known yet, or better rows than before: the block bounds itself.
            best = np.partition(near, self.k - 1, axis=1)[:, self.k - 1] + 2 * room
            passed = near <= np.minimum(limit, best)[:, None]
        q, x = np.divmod(np.flatnonzero(passed), len(rows))
        if len(q):
            self._merge(q, ids.take(pa.array(x)), self._exact(q, x, rows))

    def _sift(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray | float, np.ndarray]:
        """Approximate keys without the query's own part, that part, and the room that
        rounding errors need: more than a product of so many terms can be off."""
        squares = _finite(_squares(rows))
        longest = np.sqrt(squares.max())
        single = rows.dtype == np.float32 and max(longest, self.length.max()) < 1e15
        if not single and self.left64 is None:
            self.left64 = self._left(np.float64)
        left = self.left32 if single else self.left64
        own: np.ndarray | float = 0.0
        if self.method == "cosine":
            length = np.sqrt(squares)
            right = rows / np.where(length > 0, length, 1.0)[:, None].astype(rows.dtype)
            near = left @ right.T.astype(left.dtype, copy=False)
            near[:, length == 0] = np.inf
            near[self.length == 0] = np.inf
            size = np.ones(len(left))
        elif self.method == "dot":
            near = left @ rows.T.astype(left.dtype, copy=False)
            size = self.length * longest
        else:
            right = np.empty((len(rows), left.shape[1]), dtype=left.dtype)
            right[:, :-1] = rows
            right[:, -1] = squares
            near = left @ right.T
            own, size = self.squares, (self.length + longest) ** 2
        unit = 2.0**-24 if single else 2.0**-53
        # The first part is for keys that differ by less than they are rounded to.
        return near, own, 1e-8 * (1 + size) + 8 * (rows.shape[1] + 8) * unit * size

    def _near(self, key: np.ndarray) -> np.ndarray:
        # The bound is kept as a key; for 'euclidean' the product gives its square.
        return key * key if self.method == "euclidean" else key

    def _exact(self, q: np.ndarray, x: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The keys of chosen pairs without the cancellation of the block product."""
        out = np.empty(len(q))
        step = max(1, EXACT_CELLS // max(1, rows.shape[1]))
        for start in range(0, len(q), step):
            a = self.matrix[q[start : start + step]].astype(np.float64)
            b = rows[x[start : start + step]].astype(np.float64)
            if self.method in (INDEX_METHOD, "euclidean"):
                a -= b
                value = np.einsum("ij,ij->i", a, a)
                if self.method == "euclidean":
                    value = np.sqrt(value)
            else:
                value = -np.einsum("ij,ij->i", a, b)
                if self.method == "cosine":
                    length = np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)
                    value = np.divide(
                        value, length, out=np.full_like(value, np.inf), where=length > 0
                    )
            out[start : start + step] = value
        return np.round(out, DIGITS) + 0.0

    def _merge(self, q: np.ndarray, ids: pa.Array, keys: np.ndarray) -> None:
        new = pa.table({"q": pa.array(q, pa.int64()), "key": keys, "x_id": ids})
        both = new if self.kept is None else pa.concat_tables([self.kept, new])
        both = both.sort_by([("q", "ascending"), ("key", "ascending"), ("x_id", "ascending")])
        place = both.column("q").to_numpy()
        first = np.searchsorted(place, place, side="left")
        rank = np.arange(len(place)) - first
        self.kept = both.filter(pa.array(rank < self.k)).combine_chunks()
        full = rank == self.k - 1
        self.bound[place[full]] = both.column("key").to_numpy()[full]

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.kept is None:
            return
        table = pa.table(
            {
                "q_id": self.ids.take(_column(self.kept, "q")),
                "x_id": self.kept.column("x_id"),
                "key": self.kept.column("key"),
            }
        )
        yield from table.to_batches(max_chunksize=65536)


def _thin_copies(
    ids: pa.Array, rows: np.ndarray, k: int
) -> tuple[pa.Array, np.ndarray]:
    """Of many rows with one vector keep the k smallest ids: no other can be chosen."""
    # Equal rows nearly always get equal marks; groups are compared before rows are cut.
    mark = rows @ np.random.default_rng(0).normal(size=rows.shape[1]).astype(rows.dtype)
    order = np.argsort(mark, kind="stable")
    starts = np.flatnonzero(np.diff(mark[order], prepend=np.nan) != 0)
    sizes = np.diff(starts, append=len(rows))
    keep = np.ones(len(rows), dtype=bool)
    for start, size in zip(starts[sizes > 4 * k], sizes[sizes > 4 * k]):
        group = order[start : start + size]
        group = group[(rows[group] == rows[group[0]]).all(axis=1)]
        by_id = pc.sort_indices(ids.take(pa.array(group))).to_numpy()
        keep[group[by_id[k:]]] = False
    if keep.all():
        return ids, rows
    return ids.filter(pa.array(keep)), rows[keep]
