import hashlib
import re

import numpy as np
import pytest
from pyspark.errors import PythonException

from corpusmith.operators.embedding import (
    Embedder, embedding, hash_embedder, pack, unpack, with_embedding,
)

TEXTS = "doc_id int, content string"


def by_hand(text, dim):
    v = np.zeros(dim)
    for word in re.findall(r"[a-z0-9_]+", text.lower()):
        code = int(hashlib.md5(word.encode()).hexdigest()[:8], 16)
        v[code % dim] += 1 if (code // dim) % 2 == 0 else -1
    length = np.sqrt((v * v).sum())
    return v / length if length else v


def test_hash_embedder(spark):
    texts = ["def add(a, b):\n  return a+b", "", "  ", "É Über-Straße x_1", "A a A", None]
    df = spark.createDataFrame(list(enumerate(texts)), TEXTS).coalesce(1)
    rows = with_embedding(df, hash_embedder(16)).orderBy("doc_id").collect()
    assert rows[-1]["embedding"] is None
    for text, row in zip(texts[:-1], rows):
        assert row["embedding"] == pytest.approx(by_hand(text, 16), abs=1e-6)


def length_model(dim=2):
    def start():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    return Embedder("length", dim, start, batch_size=2)


def test_own_model_is_normalised_in_batches(spark):
    df = spark.createDataFrame([(i, "x" * i) for i in range(7)], TEXTS).coalesce(1)
    rows = with_embedding(df, length_model()).orderBy("doc_id").collect()
    for i, row in enumerate(rows):
        assert row["embedding"] == pytest.approx(np.array([i, 1]) / np.hypot(i, 1), abs=1e-6)


def test_failures_keep_their_cause(spark):
    def start():
        def encode(texts):
            if "bad" in texts:
                raise OSError("no memory")
            return np.ones((len(texts), 2))

        return encode

    model = Embedder("fails", 2, start, batch_size=1)
    df = spark.createDataFrame([(1, "good"), (2, "bad")], TEXTS).coalesce(1)
    with pytest.raises(PythonException, match="Failed to generate embeddings: no memory"):
        with_embedding(df, model).collect()
    rows = with_embedding(df, model, on_error="null").orderBy("doc_id").collect()
    assert rows[0]["embedding"] is not None and rows[1]["embedding"] is None


def test_one_bad_text_costs_no_other_its_vector(spark):
    def start():
        def encode(texts):
            if "bad" in texts:
                raise OSError("no memory")
            return np.ones((len(texts), 2))

        return encode

    df = spark.createDataFrame([(1, "good"), (2, "bad"), (3, None), (4, "fine")], TEXTS).coalesce(1)
    rows = with_embedding(df, Embedder("fails", 2, start, batch_size=8), on_error="null").orderBy("doc_id").collect()
    assert [r["embedding"] is not None for r in rows] == [True, False, False, True]


def test_model_that_cannot_start(spark):
    def start():
        raise OSError("no such file")

    df = spark.createDataFrame([(1, "x")], TEXTS)
    with pytest.raises(PythonException, match="Model initialization failed"):
        with_embedding(df, Embedder("absent", 2, start)).collect()


def test_wrong_dimension_and_option(spark):
    df = spark.createDataFrame([(1, "x")], TEXTS)
    with pytest.raises(PythonException, match="expected"):
        with_embedding(df, length_model(3)).collect()
    with pytest.raises(ValueError):
        embedding("content", length_model(), on_error="skip")


def test_packed_vectors(spark):
    rows = [(1, [1.5, -2.0]), (2, None), (3, [0.0, 3.25]), (4, [])]
    df = spark.createDataFrame(rows, "i int, v array<float>").coalesce(1)
    packed = df.select("i", pack("v").alias("p"))
    assert [r["p"] and len(r["p"]) for r in packed.orderBy("i").collect()] == [8, None, 8, bytearray()]
    back = packed.select("i", unpack("p").alias("v")).orderBy("i").collect()
    assert [tuple(r) for r in back] == rows


def test_hashing_takes_memory_by_pieces_of_text():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from corpusmith.operators import embedding as E

    texts = pa.array([f"w{i % 97} x{i % 89} y " * 700 for i in range(4000)])
    tracemalloc.start()
    whole = E._hash_words(texts, 8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20
    assert np.array_equal(whole, np.concatenate([E._hash_words(texts.slice(i, 500), 8) for i in range(0, 4000, 500)]))


def test_chunking_holds_pieces_of_text():
    import pyarrow as pa

    from corpusmith.operators import chunking

    batch = pa.record_batch({"content": pa.array(["a line\n" * 10_000] * 400 + ["", "b"])})
    pieces = list(chunking._pieces(batch, "content"))
    assert sum(p.num_rows for p in pieces) == batch.num_rows
    assert max(p.column("content").nbytes for p in pieces) <= 5 << 20
