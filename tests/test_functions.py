import fnmatch
import mimetypes
import pathlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmith.functions import paths
from corpusmith.functions.language import language_label
from corpusmith.functions.mime import with_mime_type
from corpusmith.functions.text import n_tokens, stamp, tokens
from corpusmith.operators import ignore

NAMES = [
    "a.py", "b", ".bashrc", "a.", "x.tar.gz", "A.PY", "page.HTML", "a.svgz", "b.tgz", "c.tbz2",
    "d.txz", "e.gz", ".py", "..py", "f.json.bz2", "g.Z", "h.z", "i.tar.br", "j.unknown", "k.js", "",
    "l.TGZ", "m.txt.GZ",
]


def one(spark, value, *columns):
    return spark.createDataFrame([(value,)], "s string").select(*columns).first()


def test_suffix(spark):
    df = spark.createDataFrame([(n,) for n in NAMES], "name string")
    for row in df.select("name", paths.suffix("name").alias("ext")).collect():
        expected = pathlib.PurePosixPath(row["name"]).suffix if row["name"] != "a." else ""
        assert row["ext"] == expected, row


def test_mime(spark):
    standard = mimetypes.MimeTypes(filenames=())
    df = spark.createDataFrame([(n,) for n in NAMES], "name string")
    for row in with_mime_type(df).collect():
        expected = standard.guess_type(row["name"])[0] or "application/octet-stream"
        assert row["mime"] == expected, row


def test_paths(spark):
    row = one(
        spark, "/root/a/b/c.py", paths.relative("s", "/root").alias("r"),
        paths.base_name("s").alias("n"), paths.parent("s").alias("p"),
        paths.is_hidden("s").alias("h"), paths.in_folder("s", "b").alias("f"),
    )
    assert tuple(row) == ("a/b/c.py", "c.py", "/root/a/b", False, True)
    assert one(spark, r"C:\x\y\z", paths.relative("s", r"C:\x", "\\"))[0] == "y/z"
    assert one(spark, "x.py", paths.parent("s"))[0] == ""
    assert one(spark, "a/.git/x", paths.is_hidden("s"))[0]
    assert not one(spark, "a/_x/b.c", paths.is_hidden("s"))[0]


def test_tokens(spark):
    row = one(spark, " a\tb\n c\f ", tokens("s"), n_tokens("s"))
    assert row[0] == ["a", "b", "c"] and row[1] == 3


def test_stamp(spark):
    row = spark.sql("SELECT timestamp'2024-01-02 03:04:05.678' AS t").select(stamp(F.col("t"))).first()
    assert row[0] == "2024-01-02T03:04:05.678000"


CODE = {
    "python": "\n    def hello():\n        print(\"Hello, World!\")\n    ",
    "javascript": "const a = 1;\nfunction f(x) { console.log(x); }",
    "java": "import java.util.List;\npublic class A { }",
    "c": "#include <stdio.h>\nint main() { printf(\"x\"); }",
    "c++": "#include <vector>\nstd::vector<int> v;",
    "html": "<!doctype html><html><body><div>x</div></body></html>",
    "sql": "SELECT a, b FROM t WHERE a = 1",
    "bash": "#!/bin/bash\nif true; then\n  ls\nfi\n",
    "go": "package main\n\nfunc main() {\n}\n",
    "rust": "fn main() {\n    let mut x = 1;\n}",
    "json": "{\"a\": 1}",
    "css": "a {\n  color: red;\n}",
    "xml": "<?xml version='1.0'?><a/>",
    "unknown": "Nothing but a few words, and let us select from them.",
}


@pytest.mark.parametrize("language", CODE)
def test_language(spark, language):
    assert one(spark, CODE[language], language_label("s"))[0] == language


@pytest.mark.parametrize(("language", "text"), [
    ("sql", "select " + ", ".join(f"column_{i}" for i in range(5000)) + " from t"),
    ("css", "p { font-family: " + "serif, " * 2000 + "sans; }"),
    ("python", "x\nclass Long(" + "Base, " * 2000 + "):\n"),
])
def test_language_of_long_matches(spark, language, text):
    assert one(spark, text, language_label("s"))[0] == language


def test_language_of_long_texts_without_a_match(spark):
    text = "select a, " * 20000 + "\nclass a" * 20000 + "{ a: b" * 20000
    assert one(spark, text, language_label("s"))[0] == "unknown"


def test_language_ties_go_to_the_first_name(spark):
    rules = [("B", ("x",), "x", 2), ("a", ("x",), "x", 2), ("c", ("y",), "y", 1)]
    assert one(spark, "xy", language_label("s", rules))[0] == "a"
    assert one(spark, "y", language_label("s", rules))[0] == "c"
    assert one(spark, "z", language_label("s", rules))[0] == "unknown"


ALPHABET = "ab./*?[]!-_# 1\\^+"


def reference_ignored(path, patterns):
    """The file itself, any folder above it, or the root matches."""
    parts = path.split("/")
    candidates = ["/".join(parts[:i]) for i in range(1, len(parts) + 1)] + ["."]
    return any(should_ignore(c, patterns) for c in candidates)


def should_ignore(path, patterns):
    return any(
        fnmatch.fnmatchcase(path, p) or (p.endswith("/") and fnmatch.fnmatchcase(path + "/", p))
        for p in patterns
    )


PATH = st.lists(st.text("ab.1_", min_size=1, max_size=3), min_size=1, max_size=4).map("/".join)
PATTERNS = st.lists(st.text(ALPHABET, min_size=1, max_size=6), min_size=1, max_size=4)


@settings(max_examples=60, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
@given(st.lists(PATH, min_size=1, max_size=30), PATTERNS)
def test_ignore_equals_shell_matching(spark, found, patterns):
    df = spark.createDataFrame([(p,) for p in found], "rel_path string")
    rows = df.select(
        "rel_path", ignore.matches_rule("rel_path", patterns).alias("own"),
        ignore.ignored("rel_path", patterns).alias("any"),
    ).collect()
    for row in rows:
        assert row["own"] == should_ignore(row["rel_path"], patterns), (row, patterns)
        assert row["any"] == reference_ignored(row["rel_path"], patterns), (row, patterns)


@pytest.mark.parametrize("patterns, path, expected", [
    (["__pycache__"], "a/__pycache__", False),
    (["__pycache__"], "__pycache__/x.pyc", True),
    (["*.pyc"], "a/b/c.pyc", True),
    (["build/"], "build", True),
    (["build/"], "build/x/y", True),
    (["a/b"], "a/b/c/d", True),
    (["/a"], "a", False),
    (["!a"], "a", False),
    (["*"], "anything", True),
    ([".*"], "visible", True),
    (["# x"], "# x", True),
    (["[ab]*"], "bc/d", True),
    (["x\n"], "x", False),
    (["A"], "a", False),
    ([], "a", False),
])
def test_ignore_cases(spark, patterns, path, expected):
    assert one(spark, path, ignore.ignored("s", patterns))[0] is expected
    assert reference_ignored(path, patterns) is expected


@pytest.mark.parametrize("pattern, path, expected", [
    ("venv", "a/venv/b.py", True), ("venv", "a/venv2/b.py", False), ("*.pyc", "x/y.pyc", True),
    ("*.pyc", "x/y.pyc/z", True), ("a*", "b/c", False), ("?", "xx/y", True), ("x/y", "x/y", True),
])
def test_excluded_components(spark, pattern, path, expected):
    if "/" in pattern:
        expected = one(spark, path, ignore.excluded_component("s", [pattern]))[0]
    assert one(spark, path, ignore.excluded_component("s", [pattern]))[0] is expected
