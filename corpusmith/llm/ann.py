"""Approximate nearest neighbours by largest inner product: a hierarchical k-means tree searched best bin first.

1. Usable rows.  Vectors of the table's most common length whose components are all finite and
   not all zero; every other row takes no part (neither as query nor as candidate).  Rows with
   one vector are one candidate each for scoring, but exact copies of a vector are kept only with
   their K + 1 smallest ids (K for the answer, one more in case the query is among them): by two
   rounds of row numbers, salted first, so a vector held by a third of the table is spread.
2. Inner product as distance.  With M the largest norm, x -> (x, sqrt(M^2 - |x|^2)) and
   q -> (q, 0) make |q' - x'|^2 = |q|^2 + M^2 - 2 q.x: the nearest by distance is the largest by
   inner product.
3. Tree.  Fitted on at most SAMPLE_ROWS usable rows (the smallest hashes of vec_id, a documented
   bound): k-means with BRANCH centres splits a node until it holds what LEAF_ROWS rows of the whole
   table would make, or one part in LEAF_PARTS of it if that is more: the number of leaves, and with
   it the visits of a query, stay bounded, and what grows with the table are the matrices of a leaf.  Every usable row is then put in a leaf by descending to the nearest centre;
   leaves above SPLIT_ROWS are split into salted parts, so no part of the join is larger.
4. Search.  For every query, best-bin-first: descend to the nearest leaf, pushing the other
   branches on a priority queue by distance to their centre; pop the nearest and go on until
   `probes` leaves are found.  Queries meet the rows of their leaves by an equi-join on (leaf,
   part, query block); each group's inner products are one product of matrices in double precision
   on the original vectors, and the K best of each query kept (ties: smaller vec_id).
5. Calibration.  `probes` starts at 1 and doubles until the recall on up to CAL_QUERIES queries
   (smallest hashes of their ids; their exact answers by a scan of all rows) reaches
   TARGET_RECALL, or all leaves are visited, which is exact.

Extra columns are ignored.  An empty table, or one without usable vectors, gives an empty result;
a query with fewer than K candidates gets them all.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

K = 20
QUERY_EVERY = 20
SAMPLE_ROWS = 50_000
BRANCH = 16
LEAF_ROWS = 64
LEAF_PARTS = 64
SPLIT_ROWS = 2_048
CAL_QUERIES = 256
TARGET_RECALL = 0.95
ITERATIONS = 12
SALTS = 64
QUERY_BLOCK = 2_048


class Tree:
    """Centres of a k-means tree: children of a node are contiguous, leaves numbered from 0."""

    def __init__(self, centres: np.ndarray, first: np.ndarray, count: np.ndarray, leaf: np.ndarray):
        self.centres, self.first, self.count, self.leaf = centres, first, count, leaf

    @property
    def n_leaves(self) -> int:
        return int((self.leaf >= 0).sum())

    def descend(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row of x by the nearest centre at each level."""
        node = np.zeros(len(x), dtype=np.int64)
        while True:
            inner = self.leaf[node] < 0
            if not inner.any():
                return self.leaf[node]
            for u in np.unique(node[inner]):
                at = np.nonzero(node == u)[0]
                kids = np.arange(self.first[u], self.first[u] + self.count[u])
                node[at] = kids[_distances(x[at], self.centres[kids]).argmin(1)]

    def best_bins(self, q: np.ndarray, probes: int) -> list[int]:
        """The first `probes` leaves of a best-bin-first search from q."""
        heap, found = [(0.0, 0)], []
        while heap and len(found) < probes:
            _, u = heapq.heappop(heap)
            while self.leaf[u] < 0:
                kids = np.arange(self.first[u], self.first[u] + self.count[u])
                d = ((self.centres[kids] - q) ** 2).sum(1)
                best = int(d.argmin())
                for i in range(len(kids)):
                    if i != best:
                        heapq.heappush(heap, (float(d[i]), int(kids[i])))
                u = int(kids[best])
            found.append(int(self.leaf[u]))
        return found


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres, by |x|^2 - 2 x.c + |c|^2: memory of rows x centres only."""
    return np.maximum((x * x).sum(1)[:, None] - 2.0 * (x @ c.T) + (c * c).sum(1)[None, :], 0.0)


def _kmeans(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Labels of k-means with k-means++ starts."""
    rng = np.random.default_rng(seed)
    c = x[[rng.integers(len(x))]]
    d = _distances(x, c)[:, 0]
    while len(c) < k and d.sum() > 0:
        c = np.vstack([c, x[rng.choice(len(x), p=d / d.sum())]])
        d = np.minimum(d, _distances(x, c[-1:])[:, 0])
    for _ in range(ITERATIONS):
        label = _distances(x, c).argmin(1)
        c = np.array([x[label == j].mean(0) if (label == j).any() else c[j] for j in range(len(c))])
    return _distances(x, c).argmin(1)


def fit_tree(sample: np.ndarray, leaf_size: int, seed: int = 7) -> Tree:
    """A k-means tree over the sample whose leaves hold at most about `leaf_size` of its rows."""
    centres, first, count, leaf = [sample.mean(0)], [0], [0], [-1]
    todo = [(0, np.arange(len(sample)))]
    while todo:
        u, rows = todo.pop()
        label = _kmeans(sample[rows], BRANCH, seed + u) if len(rows) > leaf_size else np.zeros(len(rows), dtype=int)
        groups = [rows[label == j] for j in np.unique(label)]
        if len(groups) < 2:
            leaf[u] = 0
            continue
        first[u], count[u] = len(centres), len(groups)
        for g in groups:
            todo.append((len(centres), g))
            centres.append(sample[g].mean(0))
            first.append(0), count.append(0), leaf.append(-1)
    leaf = np.array(leaf)
    leaf[leaf >= 0] = np.arange((leaf >= 0).sum())
    return Tree(np.array(centres), np.array(first), np.array(count), leaf)


def usable(embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, v (array<double>) of the rows that take part."""
    rows = embeddings.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    ok = rows.filter(
        F.col("id").isNotNull() & F.col("v").isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists("v", lambda x: x != 0)
    )
    common = ok.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    return ok.filter(F.size("v") == (common["dim"] if common else -1))


def _augment(v: Column, top: float) -> Column:
    return F.concat(v, F.array(F.sqrt(F.greatest(F.lit(top * top) - F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x), F.lit(0.0)))))


def _best(pairs: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def leaf_rows(n: int) -> int:
    """Rows of a table of n that a leaf may hold before it is split."""
    return max(LEAF_ROWS, -(-n // LEAF_PARTS))


class Index:
    """The fitted tree and every usable row in its leaf and part."""

    def __init__(self, embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = K):
        spark, self.k = embeddings.sparkSession, k
        rows = cut_lineage(usable(embeddings, vec_id, vector))
        self.rows = rows
        # Exact copies: their K + 1 smallest ids, first within salted parts, then over parts.
        salted = Window.partitionBy("v", "salt").orderBy("id")
        whole = Window.partitionBy("v").orderBy("id")
        kept = (
            rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
            .withColumn("r", F.row_number().over(salted)).filter(F.col("r") <= k + 1)
            .withColumn("r", F.row_number().over(whole)).filter(F.col("r") <= k + 1).select("id", "v")
        )
        kept = cut_lineage(kept)
        stats = kept.agg(F.count("*").alias("n"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("top")).first()
        self.n, self.top = stats["n"], float(stats["top"] or 0.0)
        if not self.n:
            self.tree, self.parts = None, None
            return
        # At most SAMPLE_ROWS vectors reach the driver, as one Arrow table.
        picked = kept.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).select(_augment(F.col("v"), self.top).alias("a")).toArrow()
        column = picked.column("a").combine_chunks()
        sample = column.values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
        self.tree = fit_tree(sample, max(1, round(leaf_rows(self.n) * len(sample) / self.n)))
        shared = spark.sparkContext.broadcast(self.tree)

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            tree = shared.value
            for b in batches:
                x = np.array(b["a"].tolist(), dtype=np.float64).reshape(len(b), -1)
                yield pd.DataFrame({"id": b["id"], "leaf": tree.descend(x) if len(b) else np.zeros(0, dtype=np.int64)})

        placed = kept.select("id", _augment(F.col("v"), self.top).alias("a")).mapInPandas(place, "id long, leaf long")
        placed = cut_lineage(placed)
        sizes = placed.groupBy("leaf").agg(F.count("*").alias("n"))
        # One row per leaf, at most SAMPLE_ROWS of them.
        self.parts = F.broadcast(cut_lineage(sizes.select("leaf", F.ceil(F.col("n") / SPLIT_ROWS).cast("long").alias("parts"))))
        self.members = cut_lineage(
            placed.join(kept, "id").join(self.parts, "leaf")
            .select("leaf", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part"), F.col("id").alias("vec_id"), "v")
        )
        self.shared = shared

    def search(self, queries: DataFrame, probes: int) -> DataFrame:
        """query_id, rank, vec_id, score: the K best found in `probes` leaves of every query (id, v)."""
        shared, k = self.shared, self.k

        def bins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            tree = shared.value
            for b in batches:
                ids, leaves = [], []
                for qid, v in zip(b["id"], b["v"]):
                    found = tree.best_bins(np.append(np.asarray(v, dtype=np.float64), 0.0), probes)
                    ids += [qid] * len(found)
                    leaves += found
                yield pd.DataFrame({"query_id": pd.Series(ids, dtype="int64"), "leaf": pd.Series(leaves, dtype="int64")})

        # Queries meet a leaf's part in blocks of at most about QUERY_BLOCK, so no group grows
        # with the query set; the part's rows are sent once to each block.
        blocks = max(1, -(-queries.count() // QUERY_BLOCK))
        visits = queries.select("id", "v").mapInPandas(bins, "query_id long, leaf long")
        visits = visits.join(self.parts, "leaf").select(
            "query_id", "leaf", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"),
            F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block"),
        )
        qv = queries.select(F.col("id").alias("query_id"), F.col("v").alias("q"))
        asks = visits.join(qv, "query_id")
        rows = self.members.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1))))

        def score(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            """The K best of each query among one part's rows, by one product of matrices."""
            if asked.empty or held.empty:
                return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
            q = np.array(asked["q"].tolist(), dtype=np.float64)
            m = np.array(held["v"].tolist(), dtype=np.float64)
            ids, qids = held["vec_id"].to_numpy(), asked["query_id"].to_numpy()
            s = q @ m.T
            out_q, out_v, out_s = [], [], []
            for r in range(len(q)):
                mine = ids != qids[r]
                if len(ids) > 4 * k:
                    # Only those as good as the k-th are sorted, all of its ties included.
                    mine &= s[r] >= np.partition(np.where(mine, s[r], -np.inf), -k)[-k]
                order = np.lexsort((ids[mine], -s[r][mine]))[:k]
                out_q.append(np.full(len(order), qids[r])), out_v.append(ids[mine][order]), out_s.append(s[r][mine][order])
            return pd.DataFrame({"query_id": np.concatenate(out_q), "vec_id": np.concatenate(out_v), "score": np.concatenate(out_s)})

        keys = ["leaf", "part", "block"]
        scored = asks.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInPandas(score, "query_id long, vec_id long, score double")
        return _best(scored, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

    def exact(self, queries: DataFrame) -> DataFrame:
        """The same columns with every leaf visited: a scan of all kept rows (for a bounded set of queries)."""
        return self.search(queries, self.tree.n_leaves)

    def calibrate(self, queries: DataFrame) -> tuple[int, float]:
        """The fewest doubling probes whose recall on CAL_QUERIES queries reaches TARGET_RECALL."""
        cal = cut_lineage(queries.orderBy(F.xxhash64("id"), "id").limit(CAL_QUERIES))
        truth = cut_lineage(self.exact(cal).select("query_id", "vec_id"))
        want = truth.count()
        probes, leaves = 1, self.tree.n_leaves
        while True:
            got = self.search(cal, probes).select("query_id", "vec_id").join(truth, ["query_id", "vec_id"]).count()
            recall = got / want if want else 1.0
            if recall >= TARGET_RECALL or probes >= leaves:
                return probes, recall
            probes = min(2 * probes, leaves)


def nearest(embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = K, every: int = QUERY_EVERY) -> DataFrame:
    """query_id, rank, vec_id, score for every usable row whose id is divisible by `every`."""
    index = Index(embeddings, vec_id, vector, k)
    if index.tree is None:
        return embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    queries = cut_lineage(index.rows.filter(F.pmod(F.col("id"), F.lit(every)) == 0))
    probes, recall = index.calibrate(queries)
    return index.search(queries, probes).withColumns({"probes": F.lit(probes), "calibrated_recall": F.lit(recall)})
