"""The corpus pipeline stage by stage against plain Python, on a fixture with planted cases."""

import re
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from corpusmith.llm import decontam, mix, quality, shards

SF = "/root/testdata/sf0.01"
ITEM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def _windows(text, n=10):
    w = ITEM.findall(_lower(text or ""))
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}


def _stage_rows(df):
    return Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


@pytest.fixture(scope="module")
def sf_dir(tmp_path_factory):
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    bench = pq.read_table(f"{SF}/benchmark.parquet").to_pylist()
    long_clean = [d for d in docs if d["text"] and len(d["text"].split()) > 120][:6]
    planted = []
    for i, d in enumerate(long_clean[:3]):  # exact and near copies under new ids
        planted.append(dict(d, doc_id=900000 + i))
        planted.append(dict(d, doc_id=900100 + i, text=d["text"] + " tail"))
    for i, d in enumerate(long_clean[3:5]):  # a benchmark passage inside a clean text
        planted.append(dict(d, doc_id=900200 + i, text=d["text"] + " " + bench[i]["text"]))
    planted.append(dict(docs[0], doc_id=900300, text=None))
    out = tmp_path_factory.mktemp("sf")
    pq.write_table(pa.Table.from_pylist(docs + planted, schema=pq.read_schema(f"{SF}/documents.parquet")), out / "documents.parquet")
    pq.write_table(pq.read_table(f"{SF}/benchmark.parquet"), out / "benchmark.parquet")
    return str(out)


def test_every_stage_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = []
    for name, stage in P.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != P.STAGES[-1][0]:
            assert out.columns == docs.columns
            out = spark.createDataFrame(out.collect(), docs.schema)
        seen.append((docs, out))
        docs = out
    # 1. Quality: exactly the rows that the rules keep, judged on this input.
    given, kept = seen[0]
    verdict = {r.doc_id: r.kept for r in quality.quality(given).collect()}
    assert _stage_rows(kept) == Counter((r.doc_id, r.text) for r in given.collect() if verdict[r.doc_id])
    # 2. One row of each group of near copies (brute force over shingles).
    from tests.llm.test_operators import _check_one_of_each

    given, kept = seen[1]
    rows = given.select("doc_id", "text").collect()
    sets = []
    for r in rows:
        w = [x.lower() for x in (r.text or "").encode().split()]
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    _check_one_of_each(rows, sets, kept.select("doc_id", "text").collect())
    assert not {900000, 900001, 900002, 900100, 900101, 900102} & {r.doc_id for r in kept.collect()}
    # 3. Decontamination: no document keeps a benchmark window; clean ones all stay.
    given, kept = seen[2]
    bench = set().union(*(_windows(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()))
    lengths = {len(b) for b in bench}

    def dirty(text):
        w = ITEM.findall(_lower(text or ""))
        return any(tuple(w[i:i + n]) in bench for n in lengths for i in range(len(w) - n + 1))

    assert _stage_rows(kept) == Counter((r.doc_id, r.text) for r in given.collect() if not dirty(r.text))
    assert not {900200, 900201} & {r.doc_id for r in kept.collect()}
    # 4. Mix: every row as often as the mix takes it.
    given, kept = seen[3]
    copies = {r.doc_id: r.copies for r in mix.mix_sources(given).collect()}
    assert _stage_rows(kept) == Counter({(r.doc_id, r.text): copies[r.doc_id] for r in given.collect() if copies[r.doc_id]})
    # 5. Shards: every row once, slots without holes, equal texts together.
    given, out = seen[4]
    rows = out.collect()
    assert len(rows) == given.count()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    texts = {}
    for r in rows:
        texts.setdefault(r.text, set()).add(r.shard)
    assert all(len(v) == 1 for v in texts.values())


def test_run_whole_and_empty(spark, sf_dir, tmp_path):
    assert P.run(spark, sf_dir).count() > 0
    empty = tmp_path / "empty"
    empty.mkdir()
    pq.write_table(pq.read_table(f"{SF}/documents.parquet").slice(0, 0), empty / "documents.parquet")
    pq.write_table(pq.read_table(f"{SF}/benchmark.parquet"), empty / "benchmark.parquet")
    assert P.run(spark, str(empty)).count() == 0
