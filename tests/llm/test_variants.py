"""Spelling variants against a plain Python version on small tables with nulls, ties and repeats."""

import re
import zlib
from collections import Counter

import pytest

from corpusmith.llm import variants

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def _one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            r = "".join(chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch for ch in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{r}".encode())
            if h % 31 == 0:
                k = h % len(r)
                r = r[:k] + r[k + 1:]
            if len(r) >= 7:
                n[r] += 1
    vocab = {w: c for w, c in n.items() if c >= 2}
    # Plain deletion neighbourhoods: a replacement leaves one string at one place deleted from
    # both words, an insertion makes the shorter word a deletion of the longer.
    same_cut, cuts = {}, {}
    for w in vocab:
        for i in range(len(w)):
            d = w[:i] + w[i + 1:]
            same_cut.setdefault((d, i), set()).add(w)
            cuts.setdefault(d, set()).add(w)
    near = {}
    for w in vocab:
        found = set().union(*(same_cut[(w[:i] + w[i + 1:], i)] for i in range(len(w))))
        found |= {w[:i] + w[i + 1:] for i in range(len(w))} & vocab.keys()
        found |= cuts.get(w, set())
        found.discard(w)
        assert all(_one_edit(w, t) for t in found)
        near[w] = sorted(found)
    form = {}
    for w, ts in near.items():
        best = min(ts, key=lambda t: (-vocab[t], t), default=None)
        form[w] = best if best is not None and vocab[best] >= 10 * vocab[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return [(w, form[w], root(w), vocab[w], len(near[w]), vocab[form[w]] if form[w] else None) for w in vocab]


def _key(row):
    return tuple((v is None, v) for v in row)


def test_variants_against_brute_force(spark):
    base = ["information", "informatoin", "infromation", "informaton", "informations", "Information", "INFORMATIONX"]
    rows = [(i, " ".join(base[: 1 + i % len(base)]) + " colour colours coloured colourss") for i in range(60)]
    rows += [(i, "information " * 30 + "informatio") for i in range(60, 70)]
    rows += [(None, "naïveté naïveté naïvetéx Ærodynamic ærodynamic"), (None, None), (71, ""), (72, "x" * 100000),
             (73, "abcdefg abcdefg abcdefh abcdefh abcdeff abcdeff"), (74, "abcdefg abcdefg abcdefh abcdefh"), (74, "abcdefg abcdefg")]
    df = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], "doc_id long, text string, word string, n int").repartition(3)
    got = sorted((tuple(r) for r in variants.variants(df).collect()), key=_key)
    assert got == sorted(brute(rows), key=_key)
    assert any(r[1] is not None for r in got)
    assert variants.variants(df.limit(0)).count() == 0


@pytest.mark.parametrize("table", ["documents"])
def test_variants_whole_table(spark, table):
    df = spark.read.parquet(f"/root/testdata/sf0.01/{table}.parquet")
    want = brute([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])
    got = sorted((tuple(r) for r in variants.variants(df).collect()), key=_key)
    assert got == sorted(want, key=_key)
