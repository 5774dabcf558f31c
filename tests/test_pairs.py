"""Threshold joins of vectors against a numpy scan; no cross join in the plan."""

import numpy as np
import pytest

from corpusmith.operators import pairs


def _rows(n, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 6)) * rng.uniform(0.1, 4, size=(n, 1))
    x[5] = x[3]  # a copy
    rows = [(i, [float(v) for v in x[i]]) for i in range(n)]
    return rows + [(n, None), (n + 1, [0.0] * 6), (None, [1.0] * 6)]


def _want(rows, t, method):
    ok = [(i, np.array(v)) for i, v in rows if i is not None and v is not None and (method != "cosine" or any(v))]
    out = set()
    for (i, a) in ok:
        for (j, b) in ok:
            if i < j:
                s = {"cosine": a @ b / np.linalg.norm(a) / np.linalg.norm(b), "dot": a @ b, "euclidean": -np.linalg.norm(a - b)}[method]
                if s >= t:
                    out.add((i, j, round(float(s), 6)))
    return out


@pytest.mark.parametrize("method,t", [("cosine", 0.7), ("cosine", 0.999), ("dot", 3.0), ("euclidean", -1.5)])
def test_pairs_against_scan(spark, method, t):
    rows = _rows(300, 4)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = pairs.similar_pairs(df, threshold=t, method=method)
    got = {(r.left_id, r.right_id, round(r.score, 6)) for r in found.collect()}
    want = _want(rows, t, method)
    assert got == want and len(want) > 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_pairs_of_two_tables(spark):
    rows = _rows(120, 9)
    a = spark.createDataFrame(rows[:60], "vec_id long, embedding array<double>")
    b = spark.createDataFrame(rows[60:], "id long, embedding array<double>")
    got = {(r.left_id, r.right_id) for r in pairs.similar_pairs(a, b, 0.6, right_id="id").collect()}
    want = set()
    for i, u in rows[:60]:
        for j, v in rows[60:]:
            if None not in (i, j, u, v) and any(u) and any(v):
                u_, v_ = np.array(u), np.array(v)
                if u_ @ v_ / np.linalg.norm(u_) / np.linalg.norm(v_) >= 0.6:
                    want.add((i, j))
    assert got == want


def test_blocks_meet_once(spark, monkeypatch):
    """Many small blocks, copies, an id held twice and vectors of another size: each pair once, scores exact."""
    monkeypatch.setattr(pairs, "BLOCK_ROWS", 7)
    rows = _rows(150, 5)
    rows += [(200 + i, [1.0, 2.0, 0.5]) for i in range(9)] + [(160 + i, rows[3][1]) for i in range(20)] + [(7, rows[8][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    f32 = [(i, None if v is None else [float(np.float32(x)) for x in v]) for i, v in rows]
    for method, t in (("cosine", 0.4), ("dot", -1.0), ("euclidean", -2.0)):
        got = sorted((r.left_id, r.right_id, round(r.score, 6)) for r in pairs.similar_pairs(df, threshold=t, method=method).collect())
        want = []
        usable = [(i, np.array(v)) for i, v in f32 if i is not None and v is not None and (method != "cosine" or any(v))]
        for x, (i, a) in enumerate(usable):
            for j, b in usable[x + 1:]:
                if i != j and len(a) == len(b):
                    if method == "cosine":
                        s = a @ b / np.linalg.norm(a) / np.linalg.norm(b)
                    else:
                        s = a @ b if method == "dot" else -np.linalg.norm(a - b)
                    if s >= t:
                        want.append((min(i, j), max(i, j), round(float(s), 6)))
        assert got == sorted(want)


def test_no_row_per_candidate_pair(spark):
    """Vectors the rings cannot part are compared in cells: no join makes a row per pair of vectors."""
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=16)]) for i in range(400)], "vec_id long, embedding array<float>")
    plan = pairs.similar_pairs(df, threshold=0.4)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "SortMergeJoin" not in plan
