import os

import pytest

from corpusmith.operators import bundle, corpus, ignore
from corpusmith.sources import filetree, rules
from corpusmith.settings import NO_DIRECTORY_MESSAGE, NO_DOCUMENTS_MESSAGE

FILES = {
    "__init__.py": "",
    "_c.py": "c",
    ".h.py": "h",
    ".hid/f.py": "f",
    "_priv/e.py": "e",
    "deep/er/est/n.py": "n\r\nn",
    "deep/bad.py": b"\xff\xfe\x00",
    "Makefile": "all:",
    "a.tar.gz": "z",
    "big.py": "x" * 3000,
    "concated/old.py": "o",
    "deep/concated/old.py": "o",
}


def make(root, files):
    for rel, text in files.items():
        path = root / rel
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(root)


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    return make(tmp_path_factory.mktemp("tree"), FILES)


def names(df):
    return sorted(r["rel_path"] for r in df.select("rel_path").collect())


def test_listing(spark, tree):
    hidden = {".h.py", ".hid/f.py"}
    assert names(filetree.list_files(spark, tree, include_hidden=True)) == sorted(FILES)
    assert names(filetree.list_files(spark, tree)) == sorted(set(FILES) - hidden)
    top = {f for f in FILES if "/" not in f}
    assert names(filetree.list_files(spark, tree, recursive=False)) == sorted(top - hidden)


def test_listing_columns(spark, tree):
    rows = {r["rel_path"]: r for r in filetree.list_files(spark, tree).collect()}
    row = rows["deep/er/est/n.py"]
    assert (row["dir"], row["name"], row["ext"], row["size"]) == ("deep/er/est", "n.py", ".py", 4)
    assert row["path"] == f"{tree}/deep/er/est/n.py"
    assert rows["Makefile"]["ext"] == "" and rows["a.tar.gz"]["ext"] == ".gz"


def test_linked_folders_are_not_followed(spark, tmp_path):
    make(tmp_path, {"a/x.py": "x"})
    os.symlink(tmp_path, tmp_path / "a" / "up")
    assert names(filetree.list_files(spark, str(tmp_path))) == ["a/x.py"]


def test_linked_folders_are_listed_once(spark, tmp_path):
    make(tmp_path / "tree", {"a/x.py": "x", "b/y.py": "y"})
    make(tmp_path / "outside", {"o/z.py": "zz"})
    root = tmp_path / "tree"
    os.symlink(tmp_path / "outside", root / "a" / "link1")
    os.symlink(tmp_path / "outside", root / "b" / "link2")
    os.symlink(root, root / "b" / "loop")
    got = names(filetree.list_files(spark, str(root)))
    # The outside folder is listed once, under the smaller of its two paths; the loop adds nothing.
    assert got == ["a/link1/o/z.py", "a/x.py", "b/y.py"]


def test_listing_is_written_once(spark, tmp_path):
    make(tmp_path, {"a/x.py": "x", "a/b/c/d.py": "d"})
    listed = filetree.list_files(spark, str(tmp_path))
    (tmp_path / "a" / "late.py").write_text("late")
    # Read from the written listing, not walked again.
    assert names(listed) == ["a/b/c/d.py", "a/x.py"] and names(listed) == ["a/b/c/d.py", "a/x.py"]
    assert "FileScan parquet" in listed._jdf.queryExecution().executedPlan().toString()


def test_uris(spark, tree):
    for uri in ("file:" + tree, "file://" + tree):
        files = filetree.scan(spark, uri)
        one = files.filter("rel_path = 'deep/er/est/n.py'").first()
        assert one["path"] == uri + "/deep/er/est/n.py" and one["content"] == "n\r\nn"
        assert filetree.folder_exists(uri)


def test_bodies_and_errors(spark, tree):
    files = filetree.scan(spark, tree)
    rows = {r["rel_path"]: r for r in files.collect()}
    assert rows["__init__.py"]["content"] == "" and rows["__init__.py"]["error"] is None
    assert rows["deep/er/est/n.py"]["content"] == "n\r\nn"
    bad = rows["deep/bad.py"]
    assert bad["content"] is None and bad["error"].startswith("UnicodeDecodeError")
    assert len(rows) == len(FILES) - 2
    assert "deep/bad.py" not in names(filetree.readable(files))
    assert [r["path"] for r in filetree.read_errors(files).collect()] == [f"{tree}/deep/bad.py"]


def test_missing_file_is_an_error_row(spark, tree):
    gone = filetree.list_files(spark, tree).limit(1).collect()
    schema = filetree.LISTING
    rows = [tuple(gone[0])[:0] + (f"{tree}/gone.py", "gone.py", "", "gone.py", ".py", 3)]
    got = filetree.read_bodies(spark.createDataFrame(rows, schema)).first()
    assert got["content"] is None and "gone.py" in got["error"]


def test_documents_of_a_tree(spark, tree):
    docs = filetree.as_documents(filetree.scan(spark, tree)).collect()
    one = next(d for d in docs if d["doc_id"].endswith("_c.py"))
    assert one["content"] == "c"
    assert one["metadata"] == {"file_path": one["doc_id"], "file_name": "_c.py", "file_size": "1"}


def test_extensions_and_profile(spark, tree):
    files = filetree.list_files(spark, tree, include_hidden=True)
    assert {r["ext"] for r in corpus.extensions(files).collect()} == {".py", ".gz", ""}
    total = [r for r in corpus.profile(files, "ext").collect() if r["grouping"] == 1]
    assert total[0]["n_files"] == len(FILES)
    per = {r["dir"]: r["n_files"] for r in corpus.files_per_folder(files).collect()}
    assert per["deep"] == 1 and per[""] == 6


def test_load_status():
    assert corpus.load_status(None) == ("missing", NO_DIRECTORY_MESSAGE)
    assert corpus.load_status(0) == ("empty", NO_DOCUMENTS_MESSAGE)
    assert corpus.load_status(3)[1] == "✅ Successfully processed 3 files"


def test_folder_exists(tree):
    assert filetree.folder_exists(tree) and not filetree.folder_exists(tree + "/none")


def test_ignore_rules_of_all_ancestors(tmp_path):
    root = tmp_path / "a" / "b"
    make(tmp_path, {
        "a/b/.gitignore": "*.pyc\n\n# comment\n  # not a comment\nbuild/  \r\n",
        "a/.gitignore": "!x\n[ab]*\n",
        "a/b/c/.gitignore": "never read\n",
    })
    found = rules.ignore_rules(str(root))
    assert found[:5] == ["*.pyc", "# not a comment", "build/", "!x", "[ab]*"]
    assert "never read" not in found


def test_rules_table(spark):
    got = rules.rules_table(spark, ["a", "b"]).collect()
    assert [tuple(r) for r in got] == [(1, "a"), (2, "b")]


def test_projects(spark, tmp_path):
    path = tmp_path / "projects.json"
    path.write_text("""[{"id": "1", "name": "P", "root_path": "src",
      "settings": {"llm_name": "m", "temperature": 0.5, "chunk_size": 10, "chunk_overlap": 2,
        "included_extensions": [".py"], "excluded_patterns": ["venv", "*.pyc"],
        "max_file_size": 100, "index_update_frequency": "on_demand"},
      "created_at": "2024-12-25T13:46:17.637507", "updated_at": "2024-12-25T13:46:17.637507"}]""")
    row = rules.read_projects(spark, str(path)).first()
    assert row["settings"]["included_extensions"] == [".py"]
    assert row["created_at"].year == 2024 and row["settings"]["max_file_size"] == 100


def test_project_filter(spark, tree):
    files = filetree.list_files(spark, tree)
    kept = ignore.project_filter(files, [".py"], ["_priv", "*i*_.py", "er"], 1000)
    assert names(kept) == ["_c.py", "concated/old.py", "deep/bad.py", "deep/concated/old.py"]


def bundled(spark, root, part_bytes=bundle.PART_BYTES):
    listing = ignore.bundle_inputs(
        filetree.list_files(spark, root, include_hidden=True), rules.ignore_rules(root)
    )
    files = filetree.read_bodies(listing, universal_newlines=True)
    return bundle.bundles(files, listing, part_bytes)


def block(root, rel, text):
    return f"// Source: {root}/{rel}\n// Relative path: {rel}\n{text}\n"


def test_bundles(spark, tree):
    rows = {r["dir"]: r for r in bundled(spark, tree).collect()}
    assert set(rows) == {"", ".hid", "_priv", "deep", "deep/er/est"}
    top = [(".h.py", "h"), ("__init__.py", ""), ("_c.py", "c"), ("big.py", "x" * 3000)]
    assert rows[""]["text"] == "\n".join(block(tree, *f) for f in top)
    assert rows[""]["n_files"] == 4
    # The unreadable file is counted but adds no text; line ends become '\n'.
    assert (rows["deep"]["n_files"], rows["deep"]["text"]) == (1, "")
    assert rows["deep/er/est"]["text"] == block(tree, "deep/er/est/n.py", "n\nn")


def test_bundle_files(spark, tmp_path):
    root = make(tmp_path / "proj", {"m.py": "m", "pkg/a.py": "a", "pkg/b.py": "b", "doc/x.md": "x"})
    written = bundle.write_bundles(bundled(spark, root), root).collect()
    assert {r["out_path"]: r["n_files"] for r in written} == {
        f"{root}/concated/proj_concatenated.py": 1,
        f"{root}/concated/pkg/pkg_concatenated.py": 2,
    }
    with open(f"{root}/concated/pkg/pkg_concatenated.py", encoding="utf-8") as f:
        assert f.read() == block(root, "pkg/a.py", "a") + "\n" + block(root, "pkg/b.py", "b")
    # A second run replaces the files and does not read its own output.
    assert sorted(bundle.write_bundles(bundled(spark, root), root).collect()) == sorted(written)
    assert len(list((tmp_path / "proj" / "concated").rglob("*.*"))) == 2


def test_large_folder_in_parts_is_whole(spark, tmp_path):
    files = {f"hot/f{i:03d}.py": f"text {i}" * (1 + 40 * (i == 7)) for i in range(60)} | {"small/a.py": "a"}
    root = make(tmp_path, files)
    for bad in ("a0.py", "f030x.py", "z.py"):
        (tmp_path / "hot" / bad).write_bytes(b"\xff\xfe\xff" * 50)
    want = "\n".join(block(root, r, t) for r, t in sorted(files.items()) if r.startswith("hot"))
    for part_bytes in (1 << 20, 256, 7):
        rows = bundled(spark, root, part_bytes).collect()
        hot = sorted((r for r in rows if r["dir"] == "hot"), key=lambda r: r["part_no"])
        assert [r["part_no"] for r in hot] == list(range(len(hot)))
        assert (len(hot) == 1) == (part_bytes == 1 << 20)
        assert sum(r["n_files"] for r in hot) == 63
        assert "\n".join(r["text"] for r in hot) == want
        # A part of 7 bytes is shorter than any file, also than that of the small folder.
        assert [r["part_no"] for r in rows if r["dir"] == "small"] == [0]


def test_load_status_columns_equal_the_driver_answer(spark):
    for n in (0, 1, 7):
        df = spark.createDataFrame([(n,)], "n long")
        status, message = corpus.load_status_columns(df["n"])
        assert tuple(df.select(status, message).first()) == corpus.load_status(n)
