"""Nearest neighbours by inner product against a numpy scan: exact scores, order, recall."""

import math

import numpy as np

from corpusmith.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, id string, v int"


def _brute(rows, k=20, every=20):
    ok = [(i, np.array(v, dtype=np.float32).astype(np.float64)) for i, v in rows
          if i is not None and v is not None and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for qi, q in ok:
        if qi % every:
            continue
        cand = sorted(((-float(q @ v), i) for i, v in ok if i != qi))[:k]
        out[qi] = [(i, -s) for s, i in cand]
    return out


def _table(spark, n, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 8))
    rows = [(i, [float(x) for x in (centres[i % 12] + 0.3 * rng.normal(size=8)).astype(np.float32)]) for i in range(n)]
    hot = [float(x) for x in rng.normal(size=8).astype(np.float32)]
    rows += [(n + i, hot) for i in range(300)]  # one vector held by many rows
    rows += [(n + 300, None), (n + 320, [0.0] * 8), (n + 340, [1.0, None] + [0.0] * 6), (n + 360, [float("nan")] * 8),
             (n + 380, [1.0] * 5), (None, [1.0] * 8), (n + 400, rows[0][1]), (n + 420, rows[0][1])]
    return rows, spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], SCHEMA).repartition(4)


def test_nearest_against_scan(spark):
    rows, df = _table(spark, 1500, 3)
    got = ann.nearest(df).collect()
    want = _brute(rows)
    assert {r.query_id for r in got} == set(want)
    found, hit, total = {}, 0, 0
    vec = {i: np.array(v, dtype=np.float32).astype(np.float64) for i, v in rows if i is not None and v is not None and None not in v}
    for r in got:
        assert abs(r.score - float(vec[r.query_id] @ vec[r.vec_id])) < 1e-9
        found.setdefault(r.query_id, []).append((r.rank, -r.score, r.vec_id))
    for q, w in want.items():
        mine = sorted(found[q])
        assert [x[0] for x in mine] == list(range(1, len(mine) + 1)) and len(mine) == len(w)
        assert [x[1:] for x in mine] == sorted(x[1:] for x in mine)
        hit += len({i for i, _ in w} & {x[2] for x in mine})
        total += len(w)
    assert hit / total >= 0.9
    # Unusable rows are neither queries nor candidates.
    bad = {1800, 1820, 1840, 1860, 1880}
    assert not bad & ({r.query_id for r in got} | {r.vec_id for r in got})


def test_nearest_small_and_empty(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (3, [0.2, 0.1]), (40, [1.0, 0.0]), (7, None)]
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], SCHEMA)
    got = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in ann.nearest(df).collect())
    # Each query gets all other usable rows; ties to the smaller id.
    assert got == [(0, 1, 40, 1.0), (0, 2, 20, 0.5), (0, 3, 3, 0.2), (20, 1, 0, 0.5), (20, 2, 40, 0.5), (20, 3, 3, 0.15),
                   (40, 1, 0, 1.0), (40, 2, 20, 0.5), (40, 3, 3, 0.2)]
    assert ann.nearest(df.limit(0)).count() == 0


def test_number_of_leaves_does_not_grow_with_the_table():
    """Vectors without clusters: visits of a query are bounded by the leaves, which stay as many."""
    rng = np.random.default_rng(2)
    leaves = [ann.fit_tree(rng.normal(size=(n, 16)), ann.leaf_rows(n)).n_leaves for n in (5_000, 20_000)]
    assert leaves[1] < 1.5 * leaves[0]
