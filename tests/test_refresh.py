"""Refresh as a delta: what it writes grows with the change; merged reads equal a rebuild."""

from corpusmith.operators.embedding import hash_embedder
from corpusmith.plans import index as I
from corpusmith.settings import Settings

SETTINGS = Settings(chunk_size=12, chunk_overlap=4, dim=64)
DOCS = "doc_id string, content string, metadata map<string,string>"


def snapshot(index):
    rows = index.stored().select("chunk_id", "doc_id", "content", "embedding").collect()
    return sorted((r.chunk_id, r.doc_id, r.content, tuple(round(x, 6) for x in r.embedding)) for r in rows)


def _count(spark, index, name):
    return spark.read.parquet(I._folder(index.path, index.version, name)).count()


def test_delta_writes_the_change_and_merges_like_a_rebuild(spark, tmp_path):
    table = lambda rows: spark.createDataFrame(rows, DOCS)
    base = [(f"d{i}", f"line {i}\nmore {i}", {"k": "1"}) for i in range(40)]
    one = base[:35] + [("d35", "rewritten", {"k": "1"}), ("d36", base[36][1], {"k": "2"}), ("n1", "new one", {})]
    two = [r for r in one if r[0] not in ("d0", "d35")] + [("d35", "again", {"k": "1"}), ("d0", "back", {}), ("n2", "two", {})]
    model = hash_embedder(64)
    path = str(tmp_path / "idx")
    v1 = I.build_index(table(base), path, SETTINGS, model)
    v2 = I.refresh_index(v1, table(one))
    # Changed d35, relabelled d36, added n1; removed d37 d38 d39.
    assert v2.layers == (v1.version, v2.version)
    assert _count(spark, v2, "documents") == 3
    assert _count(spark, v2, "tombstones") == 5
    assert _count(spark, v2, "plan") == 6
    assert snapshot(v2) == snapshot(I.build_index(table(one), str(tmp_path / "r1"), SETTINGS, model))
    v3 = I.refresh_index(I.load_index(spark, path, model), table(two))
    assert v3.layers == (v1.version, v2.version, v3.version)
    assert _count(spark, v3, "documents") == 3
    rebuilt = snapshot(I.build_index(table(two), str(tmp_path / "r2"), SETTINGS, model))
    assert snapshot(v3) == rebuilt
    assert sorted(r.doc_id for r in v3.documents.collect()) == sorted(r[0] for r in two)
    assert I.load_index(spark, path, model).layers == v3.layers
    v4 = I.compact(v3)
    assert v4.layers == () and snapshot(v4) == rebuilt
    loaded = I.load_index(spark, path, model)
    assert loaded.version == v4.version and loaded.layers == ()
    info = loaded.info().first()
    assert info.kind == "full" and info.n_documents == len(two)


def test_delta_of_nothing(spark, tmp_path):
    table = lambda rows: spark.createDataFrame(rows, DOCS)
    rows = [("a", "x", {}), ("b", "y", {})]
    v1 = I.build_index(table(rows), str(tmp_path / "i"), SETTINGS, hash_embedder(64))
    v2 = I.refresh_index(v1, table(rows))
    assert _count(spark, v2, "documents") == 0 and _count(spark, v2, "vectors") == 0
    assert snapshot(v2) == snapshot(v1)
    v3 = I.refresh_index(v2, table([]))
    assert v3.documents.count() == 0 and v3.stored().count() == 0


def test_concurrent_builds_both_survive(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    table = lambda rows: spark.createDataFrame(rows, DOCS)
    path = str(tmp_path / "shared")
    model = hash_embedder(64)
    sets = [[(f"a{i}", f"first {i}", {}) for i in range(20)], [(f"b{i}", f"second {i}", {}) for i in range(30)]]
    with ThreadPoolExecutor(2) as pool:
        built = list(pool.map(lambda rows: I.build_index(table(rows), path, SETTINGS, model), sets))
    assert len({b.version for b in built}) == 2
    for b, rows in zip(built, sets):
        assert sorted(r.doc_id for r in b.documents.collect()) == sorted(r[0] for r in rows)
    assert sorted(r.version for r in I._manifest(spark, path).collect()) == sorted(b.version for b in built)
    assert I.load_index(spark, path, model).version == max(b.version for b in built)


def test_sweep_removes_what_a_dead_build_left(spark, tmp_path):
    path = str(tmp_path / "s")
    v1 = I.build_index(spark.createDataFrame([("a", "x", {})], DOCS), path, SETTINGS, hash_embedder(64))
    dead = I.claim_version(spark, path)
    spark.createDataFrame([("a", "x", {}, "s")], I.DOCUMENTS).write.parquet(I._folder(path, dead, "documents"))
    assert I.sweep(spark, path, older_than_s=3600) == []
    assert I.sweep(spark, path, older_than_s=-1) == [dead]
    assert not (tmp_path / "s" / f"version={dead:06d}").exists()
    assert I.load_index(spark, path).version == v1.version and I.claim_version(spark, path) == dead
