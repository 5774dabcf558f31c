import numpy as np
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from corpusmith.functions import vectors as V
from corpusmith.operators.embedding import pack
from corpusmith.operators.knn import DIGITS, nearest, nearest_to_one

VECTORS = "vec_id bigint, embedding array<float>"
ZERO = [0.0, 0.0, 0.0]


def table(spark, rows):
    return spark.createDataFrame(rows, VECTORS)


def brute(q, x, k, method):
    """Ranks by a plain loop over all pairs."""
    out = []
    for qid, a in q:
        keyed = []
        for xid, b in x:
            a_, b_ = np.float32(a).astype(float), np.float32(b).astype(float)
            length = np.linalg.norm(a_) * np.linalg.norm(b_)
            key = {
                "l2": ((a_ - b_) ** 2).sum(),
                "euclidean": np.sqrt(((a_ - b_) ** 2).sum()),
                "dot": -a_ @ b_,
                "cosine": -(a_ @ b_) / length if length else np.inf,
            }[method]
            keyed.append((round(float(key), DIGITS) + 0.0, xid))
        out += [(qid, r, xid) for r, (_, xid) in enumerate(sorted(keyed)[:k], 1)]
    return out


def ranks(df):
    rows = df.select("query_id", "rank", "vec_id").collect()
    return sorted(tuple(r) for r in rows)


def test_measures(spark):
    df = spark.createDataFrame(
        [([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])],
        "a array<float>, b array<float>",
    )
    got = df.select(
        V.dot("a", "b"), V.cosine("a", "b"), V.euclidean("a", "b"), V.squared_l2("a", "b")
    ).collect()
    assert got[0][0] == 24 and got[0][1] == pytest.approx(0.96)
    assert got[0][2] == pytest.approx(-np.sqrt(2)) and got[0][3] == 2
    assert got[1][1] is None and got[1][2] == -1


def test_unknown_method_is_an_error(spark):
    with pytest.raises(ValueError, match="Invalid similarity method"):
        V.similarity("a", "b", "manhattan")
    t = table(spark, [(1, [1.0])])
    with pytest.raises(ValueError, match="Invalid similarity method"):
        nearest(t.withColumnRenamed("vec_id", "query_id"), t, method="manhattan")


def test_normalize(spark):
    t = table(spark, [(1, [3.0, 4.0, 0.0]), (2, ZERO)])
    rows = t.orderBy("vec_id").select(V.normalize("embedding").alias("u")).collect()
    assert rows[0]["u"] == pytest.approx([0.6, 0.8, 0.0])
    assert rows[1]["u"] == [None, None, None]


def test_dimension_check(spark):
    t = spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<float>, b array<float>")
    with pytest.raises(Exception, match="differ in dimension"):
        t.select(V.similarity("a", "b")).collect()


@pytest.mark.parametrize("method", ["l2", "cosine", "dot", "euclidean"])
@pytest.mark.parametrize("grid", [False, True])
def test_nearest_equals_brute_force(spark, method, grid):
    rng = np.random.default_rng(7)
    x = [(i, rng.normal(size=3).round(2).tolist()) for i in range(60)]
    x += [(100 + i, x[3][1]) for i in range(20)] + [(200, ZERO)]
    q = [(i, rng.normal(size=3).round(2).tolist()) for i in range(8)] + [(8, x[3][1]), (9, ZERO)]
    options = {"broadcast_bytes": 1, "block_queries": 4, "cells": 9} if grid else {}
    got = nearest(
        table(spark, q).withColumnRenamed("vec_id", "query_id"),
        table(spark, x).repartition(5), 4, method, **options,
    )
    assert ranks(got) == sorted(brute(q, x, 4, method))


@pytest.mark.parametrize("grid", [False, True])
def test_packed_vectors_give_the_same(spark, grid):
    rng = np.random.default_rng(3)
    t = table(spark, [(i, rng.normal(size=5).tolist() if i % 9 else None) for i in range(80)])
    p = t.select("vec_id", pack("embedding").alias("p")).repartition(3)
    q = "query_id"
    options = {"broadcast_bytes": 1, "block_queries": 30, "cells": 6} if grid else {}
    plain = nearest(t.withColumnRenamed("vec_id", q), t, 4, **options)
    packed = nearest(
        p.withColumnRenamed("vec_id", q), p, 4, query_vector="p", vector="p", **options
    )
    assert sorted(plain.collect()) == sorted(packed.collect())
    assert plain.count() == 4 * 71


@pytest.mark.parametrize("grid", [False, True])
def test_copies_of_one_vector_do_not_push_out_smaller_ids(spark, grid):
    """Most rows are one vector: the smallest ids must win."""
    one = [1.0, 0.0, 0.0]
    rows = spark.range(0, 60000, 1, 3).select(
        (60000 - F.col("id")).alias("vec_id"),
        F.when(F.col("id") % 7 == 0, F.array(F.lit(0.0), F.lit(1.0), F.lit(0.0)))
        .otherwise(F.array(*(F.lit(v) for v in one))).cast("array<float>").alias("embedding"),
    )
    q = table(spark, [(i, one) for i in range(40)]).withColumnRenamed("vec_id", "query_id")
    options = {"broadcast_bytes": 1, "block_queries": 16, "cells": 6} if grid else {}
    got = nearest(q, rows, 3, **options)
    expected = sorted(60000 - i for i in range(60000) if i % 7)[:3]
    assert ranks(got) == [(i, r, v) for i in range(40) for r, v in enumerate(expected, 1)]


def test_undefined_cosine_is_null_and_last(spark):
    t = table(spark, [(1, [1.0, 0.0]), (2, [0.0, 0.0])])
    got = nearest(t.withColumnRenamed("vec_id", "query_id"), t, 2, "cosine").orderBy(
        "query_id", "rank"
    ).collect()
    assert [(r["vec_id"], r["score"]) for r in got[:2]] == [(1, 1.0), (2, None)]
    assert [r["score"] for r in got[2:]] == [None, None]


def test_fewer_rows_than_k_and_null_vectors(spark):
    t = table(spark, [(1, [1.0, 0.0]), (2, None)])
    got = nearest(t.withColumnRenamed("vec_id", "query_id"), t, 5)
    assert ranks(got) == [(1, 1, 1)]
    none = t.filter("vec_id > 9")
    assert nearest(none.withColumnRenamed("vec_id", "query_id"), t, 5).count() == 0
    assert nearest(t.withColumnRenamed("vec_id", "query_id"), none, 5).count() == 0


def test_wrong_dimension_fails(spark):
    q = table(spark, [(1, [1.0, 0.0])]).withColumnRenamed("vec_id", "query_id")
    with pytest.raises(PythonException, match="dimension"):
        nearest(q, table(spark, [(1, [1.0, 0.0, 0.0])])).collect()


def test_self_is_nearest(spark):
    t = table(spark, [(i, [float(i), 1.0]) for i in range(50)])
    got = nearest(t.withColumnRenamed("vec_id", "query_id"), t, 1).collect()
    assert all(r["query_id"] == r["vec_id"] and r["distance"] == 0 for r in got)


def test_one_query_is_an_ordered_limit(spark):
    t = table(spark, [(i, [float(i)]) for i in range(9)])
    got = nearest_to_one(t, [4.2], 3)
    assert [r["vec_id"] for r in got.collect()] == [4, 5, 3]
    assert "TakeOrderedAndProject" in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("grid", [False, True])
@pytest.mark.parametrize("bad", [float("nan"), float("inf"), None])
@pytest.mark.parametrize("at", [0, 10, 20])
def test_an_unusable_entry_is_an_error_wherever_it_stands(spark, bad, at, grid):
    rows = [(i, [float(i), bad if i == at else 1.0]) for i in range(21)]
    q = table(spark, [(1, [1.0, 0.0])]).withColumnRenamed("vec_id", "query_id")
    limit = {"broadcast_bytes": 0, "cells": 2} if grid else {}
    with pytest.raises(PythonException, match="NULL"):
        nearest(q, table(spark, rows), 3, **limit).collect()
    with pytest.raises(Exception, match="NULL"):
        nearest_to_one(table(spark, rows), [1.0, 0.0], 3).collect()


def test_one_query_leaves_out_null_vectors_and_fails_on_other_sizes(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0])]
    got = nearest_to_one(table(spark, rows), [1.0, 0.0], 3).collect()
    assert [r["vec_id"] for r in got] == [1, 3]
    with pytest.raises(Exception, match="differ in dimension"):
        nearest_to_one(table(spark, [*rows, (4, [1.0])]), [1.0, 0.0], 3).collect()
    with pytest.raises(ValueError, match="NaN"):
        nearest_to_one(table(spark, rows), [float("nan"), 0.0], 3)


def test_a_task_holds_a_bounded_block_of_queries(spark, monkeypatch):
    """More queries than a block are cut into a grid by default, also by the width of their vectors."""
    from corpusmith.operators import knn

    held, grid = [], knn._grid
    monkeypatch.setattr(knn, "_against_all", lambda *a: pytest.fail("all queries went to every task"))
    monkeypatch.setattr(knn, "_grid", lambda *a: held.append(a[4]) or grid(*a))
    wide = spark.range(3000).select(F.col("id").alias("query_id"), F.array_repeat(F.col("id").cast("float"), 500).alias("embedding"))
    few = spark.range(7).select(F.col("id").alias("vec_id"), F.array_repeat(F.col("id").cast("float"), 500).alias("embedding"))
    got = nearest(wide, few, 1).filter("query_id < 4").collect()
    assert sorted((r.query_id, r.vec_id) for r in got) == [(i, i) for i in range(4)]
    assert held == [2]


def test_exact_keys_take_little_memory():
    import tracemalloc

    from corpusmith.operators.knn import _Best
    import pyarrow as pa

    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 64)).astype(np.float32)
    best = _Best(pa.array(np.arange(4000)), x, 5, "l2")
    q, other = np.divmod(np.arange(200_000), 50)
    tracemalloc.start()
    best._exact(q, other, x[:50])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20
