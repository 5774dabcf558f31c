import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from corpusmith.operators.chunking import (
    _spans, chunk_lines, chunk_windows, line_numbers, with_links,
)
from corpusmith.settings import Settings

DOC = "doc_id bigint, content string, lang string"


def lines(spark, text, size, overlap):
    df = chunk_lines(spark.createDataFrame([(1, text, "en")], DOC), size, overlap)
    return [
        (r["content"], r["start_line"], r["end_line"], r["n_tokens"], r["lang"])
        for r in df.orderBy("chunk_no").collect()
    ]


def test_empty_text_is_one_chunk(spark):
    assert lines(spark, "", 10, 2) == [("", 1, 1, 1, "en")]


def test_line_over_budget_stands_alone(spark):
    got = lines(spark, "a b c d e\nf\ng", 3, 1)
    assert [(c, s, e) for c, s, e, _, _ in got] == [("a b c d e", 1, 1), ("f\ng", 2, 3)]


def test_exact_budget_and_overlap(spark):
    got = lines(spark, "a b\nc\nd\ne f", 4, 1)
    assert [(c, s, e, n) for c, s, e, n, _ in got] == [
        ("a b\nc\nd", 1, 3, 4), ("d\ne f", 3, 4, 3),
    ]


def test_trailing_newline_and_unicode(spark):
    got = lines(spark, "é ü\n😀\n", 2, 0)
    assert [(c, s, e) for c, s, e, _, _ in got] == [("é ü", 1, 1), ("😀\n", 2, 3)]


def test_null_text_has_no_chunk(spark):
    docs = spark.createDataFrame([(1, None, "en"), (2, "x", "en")], DOC)
    assert [r["doc_id"] for r in chunk_lines(docs).collect()] == [2]
    assert [r["doc_id"] for r in chunk_windows(docs).collect()] == [2]


def test_bad_sizes():
    for size, overlap in ((0, 0), (10, 10), (10, 11), (-1, 0), (5, -1)):
        with pytest.raises(ValueError):
            Settings(chunk_size=size, chunk_overlap=overlap)
    web = Settings().web()
    assert (web.chunk_size, web.chunk_overlap, web.recursive) == (1024, 128, False)


@settings(max_examples=200, suppress_health_check=[HealthCheck.too_slow])
@given(st.lists(st.integers(1, 9), min_size=1, max_size=40), st.integers(1, 20), st.data())
def test_spans(counts, size, data):
    overlap = data.draw(st.integers(0, size - 1))
    cum = [sum(counts[:i]) for i in range(len(counts) + 1)]
    spans = _spans(cum, size, overlap)
    covered = set()
    for s, e in spans:
        assert s == e or cum[e + 1] - cum[s] <= size
        covered |= set(range(s, e + 1))
    assert covered == set(range(len(counts)))
    for (s, e), (s2, _) in zip(spans, spans[1:]):
        # The first line after s from which the rest of the chunk fits the overlap.
        fits = [j for j in range(s + 1, e + 1) if cum[e + 1] - cum[j] <= overlap]
        assert s2 == (fits[0] if fits else e + 1)


def test_windows(spark):
    text = " ".join(f"t{i}" for i in range(10))
    df = chunk_windows(spark.createDataFrame([(1, text, "en"), (2, " \n", "fr")], DOC), 4, 1)
    got = [(r["doc_id"], r["content"], r["lang"]) for r in df.orderBy("doc_id", "chunk_no").collect()]
    assert got == [
        (1, "t0 t1 t2 t3", "en"), (1, "t3 t4 t5 t6", "en"), (1, "t6 t7 t8 t9", "en"), (2, "", "fr"),
    ]


def test_links_and_stable_ids(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc", "en"), (2, "z", "en")], DOC)
    first = with_links(chunk_lines(docs, 1, 0)).orderBy("doc_id", "chunk_no").collect()
    again = with_links(chunk_lines(docs.repartition(3), 1, 0)).orderBy("doc_id", "chunk_no").collect()
    assert [r["chunk_id"] for r in first] == [r["chunk_id"] for r in again]
    assert [r["prev_id"] for r in first] == [None, first[0]["chunk_id"], first[1]["chunk_id"], None]
    assert [r["next_id"] for r in first] == [first[1]["chunk_id"], first[2]["chunk_id"], None, None]


def test_line_numbers(spark):
    df = line_numbers(spark.createDataFrame([(1, "a b\n\nc", "en"), (2, "x y z", "fr")], DOC))
    got = [tuple(r) for r in df.select("doc_id", "content", "line_no", "n_tokens", "running_tokens")
           .orderBy("doc_id", "line_no").collect()]
    assert got == [(1, "a b", 1, 2, 2), (1, "", 2, 1, 3), (1, "c", 3, 1, 4), (2, "x y z", 1, 3, 3)]
