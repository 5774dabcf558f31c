import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmith.operators import history, results
from corpusmith.operators.embedding import Embedder, hash_embedder
from corpusmith.plans import ask as A
from corpusmith.plans import index as I
from corpusmith.settings import NO_INDEX_MESSAGE, Settings
from corpusmith.sources import filetree

MAIN = '''
def add(a: int, b: int) -> int:
    """Sum of two numbers."""
    return a + b

def subtract(a: int, b: int) -> int:
    return a - b
'''
UTILS = '''
def validate_input(value) -> bool:
    return isinstance(value, int)

def process_data(data: list) -> list:
    """Doubles the numbers of a list."""
    return [x * 2 for x in data if validate_input(x)]
'''
SETTINGS = Settings(chunk_size=12, chunk_overlap=4, dim=64)
DOCS = "doc_id string, content string, metadata map<string,string>"


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("code")
    (root / "main.py").write_text(MAIN)
    (root / "utils.py").write_text(UTILS)
    return filetree.as_documents(filetree.scan(spark, str(root)))


@pytest.fixture(scope="module")
def index(docs, tmp_path_factory):
    return I.build_index(docs, str(tmp_path_factory.mktemp("index")), SETTINGS)


def questions(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id bigint, query string")


def snapshot(index):
    rows = index.stored().select(
        "chunk_id", "doc_id", "chunk_no", "content", "metadata", "embedding", "prev_id", "next_id"
    ).collect()
    return sorted(rows, key=lambda r: r["chunk_id"])


def test_build(index, docs):
    info = index.info().first()
    assert (info["model_name"], info["embedding_dimension"]) == ("hash-64", 64)
    assert info["n_documents"] == 2 == docs.count()
    assert info["n_chunks"] == index.vectors.count() == index.chunks.count() > 2
    paths = {r["p"] for r in index.chunks.select(results.file_path("metadata").alias("p")).collect()}
    assert paths == {r["doc_id"] for r in docs.collect()}


def test_save_and_load(spark, index, tmp_path):
    I.save_index(index, str(tmp_path))
    loaded = I.load_index(spark, str(tmp_path))
    assert loaded.settings == SETTINGS and snapshot(loaded) == snapshot(index)


def test_save_without_index_warns(tmp_path, caplog):
    I.save_index(None, str(tmp_path))
    assert "No index to save" in caplog.text and not list(tmp_path.iterdir())


def test_load_errors(spark, index, tmp_path):
    with pytest.raises(FileNotFoundError, match="No index found"):
        I.load_index(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError, match="dimension 64"):
        I.load_index(spark, index.path, hash_embedder(32))
    other = Embedder("other", 64, lambda: None)
    with pytest.raises(ValueError, match="built with hash-64"):
        I.load_index(spark, index.path, other)


def test_empty_store_is_made_once(spark, index, tmp_path):
    path = str(tmp_path / "store")
    empty = I.init_store(spark, path, SETTINGS)
    assert empty.chunks.count() == 0 and empty.version == 0
    assert A.similar(empty, questions(spark, "x")).count() == 0
    assert I.init_store(spark, path, SETTINGS).version == 0
    assert I.init_store(spark, index.path, SETTINGS).version == index.version


def test_failed_build_leaves_the_old_version(spark, docs, index):
    def start():
        raise OSError("no model")

    with pytest.raises(RuntimeError, match="Index creation failed"):
        I.build_index(docs, index.path, SETTINGS, Embedder("hash-64", 64, start))
    assert I.load_index(spark, index.path).version == index.version


def test_refresh_equals_rebuild(spark, tmp_path):
    old = [("a", "one\ntwo", {}), ("b", "gone", {}), ("c", "same\ntext", {"k": "1"})]
    new = [("a", "one\nthree", {}), ("c", "same\ntext", {"k": "2"}), ("d", "fresh", {})]
    table = lambda rows: spark.createDataFrame(rows, DOCS)
    path = str(tmp_path / "a")
    opened = tmp_path / "embedded"
    opened.mkdir()

    def start():
        def encode(texts):
            for t in texts:
                (opened / t.replace("\n", "_")).touch()
            return np.array([[len(t), t.count("e") + 1.0] for t in texts])

        return encode

    model = Embedder("m", 2, start)
    index = I.build_index(table(old), path, SETTINGS, model)
    for f in opened.iterdir():
        f.unlink()
    fresh = I.refresh_index(index, table(new))
    # Only the changed and the added text went through the model.
    assert {f.name for f in opened.iterdir()} == {"one_three", "fresh"}
    again = I.build_index(table(new), str(tmp_path / "b"), SETTINGS, model)
    assert snapshot(fresh) == snapshot(again)
    assert I.load_index(spark, path, model).version == fresh.version
    states = I.refresh_plan(index.documents, fresh.documents).collect()
    assert {r["doc_id"]: r["state"] for r in states} == {
        "a": "changed", "b": "removed", "c": "unchanged", "d": "added",
    }


def test_similar_code(spark, index):
    found = A.similar(index, questions(spark, "def multiply(a: int, b: int) -> int:"), 3)
    rows = found.orderBy("rank").collect()
    assert [r["rank"] for r in rows] == [1, 2, 3]
    scores = [r["result"]["score"] for r in rows]
    assert scores == sorted(scores) and min(scores) >= 0
    assert "def add" in rows[0]["result"]["document"]["content"]
    assert rows[0]["result"]["document"]["metadata"]["file_name"] == "main.py"


def test_chunk_is_nearest_to_itself(spark, index):
    chunks = index.chunks.select(F.col("chunk_id").alias("query_id"), F.col("content").alias("query"))
    rows = A.search(index, chunks, 1).collect()
    assert all(r["distance"] == 0 for r in rows) and len(rows) == index.chunks.count()


def test_ask(spark, index):
    asked = questions(spark, "Explain the process_data function", "", "  ", "What does add do?")
    rows = A.ask(index, asked, show_sources=True).orderBy("query_id").collect()
    assert [r["status"] for r in rows] == ["ok", "error", "error", "ok"]
    assert "process_data" in rows[0]["response"] and len(rows[0]["sources"]) == 5
    assert "\n\n📚 Source Files:\n1. /" in rows[0]["response"]
    assert "error" in rows[1]["response"].lower() and rows[1]["sources"] == []
    assert all(r["confidence"] == 0.0 and r["timestamp"] for r in rows)
    assert rows[0]["metadata"]["timestamp"].startswith("20")
    plain = A.ask(index, asked).orderBy("query_id").collect()
    assert "📚" not in plain[0]["response"]


def test_ask_without_index(spark):
    row = A.ask(None, questions(spark, "anything")).first()
    assert (row["status"], row["response"], row["sources"]) == ("no_index", NO_INDEX_MESSAGE, [])


def test_generator_sees_system_text_and_all_packs(spark, index):
    def count(batch):
        assert batch["system"].str.startswith("You are an expert").all()
        return [f"{q}|{n}|{len(c)}" for q, n, c in zip(batch["query"], batch["pack_no"], batch["context"])]

    # Every chunk fills a pack of its own; the short answers then share one.
    rows = A.ask(index, questions(spark, "add"), 3, count, budget=12).collect()
    assert rows[0]["response"].startswith("add|0|") and len(rows[0]["sources"]) == 3


def test_summaries_that_get_no_shorter_come_to_an_end(spark, index):
    row = A.ask(index, questions(spark, "add"), 3, lambda b: ["w " * 50] * len(b), budget=12).first()
    assert (row["status"], row["response"]) == ("ok", "w " * 50)


def test_a_failing_question_is_a_row(spark, index):
    def refuse(batch):
        if "bad" in list(batch["query"]):
            raise ValueError("no answer to that")
        return ["fine"] * len(batch)

    rows = A.ask(index, questions(spark, "add", "bad", "", "sub"), 2, refuse).collect()
    got = {r["query"]: (r["status"], r["response"]) for r in rows}
    assert got["add"] == got["sub"] == ("ok", "fine")
    assert got["bad"][0] == "error" and got["bad"][1].endswith("no answer to that")
    assert got[""][0] == "error" and len(rows) == 4


def test_packs_and_context(spark):
    hits = spark.createDataFrame(
        [(1, 2, "c d"), (1, 1, "a b"), (1, 3, "e"), (1, 4, "f g h i"), (2, 1, "x")],
        "query_id int, rank int, content string",
    )
    packs = results.with_packs(hits, 3)
    got = {(r["query_id"], r["rank"]): r["pack_no"] for r in packs.collect()}
    assert got == {(1, 1): 0, (1, 2): 1, (1, 3): 1, (1, 4): 2, (2, 1): 0}
    context = {(r["query_id"], r["pack_no"]): r["context"] for r in results.packed_context(packs).collect()}
    assert context == {(1, 0): "a b", (1, 1): "c d\n\ne", (1, 2): "f g h i", (2, 0): "x"}


def test_results_have_defaults(spark):
    df = spark.createDataFrame([(None, {"a": "b"}), (0.5, None)], "score double, m map<string,string>")
    rows = df.select(
        results.search_result(F.lit("c"), F.col("m"), F.col("score")).alias("r"),
        results.file_path("m").alias("p"),
    ).collect()
    assert [r["r"]["score"] for r in rows] == [0.0, 0.5]
    assert [r["p"] for r in rows] == ["Unknown", "Unknown"]


def test_listing(spark):
    df = spark.createDataFrame([(["a", "b"],)], "p array<string>")
    shown = df.select(results.source_listing(F.col("p")), results.source_listing(F.col("p"), False)).first()
    assert tuple(shown) == ("\n\n📚 Source Files:\n1. a\n2. b", "")


TALK = "conv_id bigint, turn bigint, role string, text string"
ANSWERS = "conv_id bigint, ask_no bigint, query string, response string"


@pytest.mark.parametrize("width", [1, 3, 65536])
def test_append(spark, width):
    talk = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "r")], TALK)
    answers = spark.createDataFrame(
        [(1, 10 * i, f"q{i}", f"r{i}") for i in range(20)] + [(7, 5, "x", "❌ Error: y")], ANSWERS
    )
    rows = history.append_answers(talk, answers, width).collect()
    one = sorted((r["turn"], r["role"], r["text"]) for r in rows if r["conv_id"] == 1)
    assert [t for t, _, _ in one] == list(range(42))
    assert one[2:4] == [(2, "user", "q0"), (3, "assistant", "r0")]
    assert one[-1] == (41, "assistant", "r19")
    new = sorted((r["turn"], r["text"]) for r in rows if r["conv_id"] == 7)
    assert new == [(0, "x"), (1, "❌ Error: y")]


def test_clear(spark):
    talk = spark.createDataFrame([(1, 0, "user", "a"), (2, 0, "user", "b")], TALK)
    gone = spark.createDataFrame([(2,), (2,), (5,)], "conv_id bigint")
    assert [r["conv_id"] for r in history.clear(talk, gone).collect()] == [1]
