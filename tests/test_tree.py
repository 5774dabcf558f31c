import json

import pytest

from corpusmith import __main__ as cli
from corpusmith.plans import tree
from corpusmith.settings import Settings
from corpusmith.sources import rules

FILES = {"main.py": "def add(a, b):\n    return a + b\n", "lib/util.py": "x = 1\n",
         "lib/note.md": "text\n", "lib/skip.pyc": "no\n", ".git/c.py": "no\n"}


@pytest.fixture
def root(tmp_path):
    for rel, text in FILES.items():
        path = tmp_path / "code" / rel
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return tmp_path / "code"


def test_index_tree(spark, root, tmp_path):
    small = Settings(dim=16)
    index, status, message = tree.index_tree(spark, str(root), str(tmp_path / "i"), small)
    assert (status, message) == ("ok", "✅ Successfully processed 4 files")
    assert index.documents.count() == 4
    _, status, message = tree.index_tree(spark, str(root), str(tmp_path / "w"), small.web())
    assert message == "✅ Successfully processed 1 files"


def test_index_tree_says_what_is_wrong(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    for folder, status, message in (
        ("none", "missing", "❌ Directory does not exist"),
        ("empty", "empty", "❌ No documents found in directory"),
    ):
        got = tree.index_tree(spark, str(tmp_path / folder), str(tmp_path / "i"))
        assert got == (None, status, message)


def test_index_tree_reports_failures(spark, root, tmp_path):
    (tmp_path / "file").write_text("in the way")
    _, status, message = tree.index_tree(spark, str(root), str(tmp_path / "file" / "i"))
    assert status == "error" and message.startswith("❌ Error: Index creation failed")


def test_project(spark, root, tmp_path):
    settings = {
        "llm_name": "m", "temperature": 0.1, "chunk_size": 64, "chunk_overlap": 8,
        "included_extensions": [".py"], "excluded_patterns": ["*.pyc", ".git"],
        "max_file_size": 1000, "index_update_frequency": "on_demand",
    }
    path = tmp_path / "projects.json"
    path.write_text(json.dumps([{"id": "1", "name": "n", "root_path": "code", "settings": settings}]))
    project = rules.read_projects(spark, str(path)).first()
    found = tree.project_files(spark, project, str(tmp_path)).select("rel_path").collect()
    assert sorted(r[0] for r in found) == ["lib/util.py", "main.py"]
    index, status, _ = tree.index_project(spark, project, str(tmp_path / "i"), str(tmp_path))
    assert status == "ok" and index.settings.chunk_size == 64


def test_bundle_tree_mirrors_folders(spark, root):
    (root / ".gitignore").write_text("*.pyc\n.git/\nout\n")
    for rel in ("docs/deep/x.md", "out/y.py"):
        (root / rel).parent.mkdir(parents=True)
        (root / rel).write_text("x")
    written = tree.bundle_tree(spark, str(root)).collect()
    assert len(written) == 2
    top = root / "concated"
    assert sorted(str(p.relative_to(top)) for p in top.rglob("*")) == [
        "code_concatenated.py", "docs", "docs/deep", "lib", "lib/lib_concatenated.py",
    ]


def test_command_line(spark, root, tmp_path, capsys):
    assert cli.main(["bundle", str(root)]) == 0
    out = capsys.readouterr().out
    assert f"Created {root}/concated/lib/lib_concatenated.py from 1 files" in out
    assert out.endswith("Concatenation complete!\n")
    assert cli.main(["index", str(root / "lib"), str(tmp_path / "i")]) == 0
    assert cli.main(["index", str(root / "none"), str(tmp_path / "j")]) == 1
    capsys.readouterr()
    assert cli.main(["ask", str(tmp_path / "i"), "x = 1", "--sources"]) == 0
    assert "📚 Source Files:" in capsys.readouterr().out
    assert cli.main(["similar", str(tmp_path / "i"), "x = 1", "-k", "1"]) == 0
    assert "lib/util.py:1 0.000000" in capsys.readouterr().out
    assert cli.main(["ask", str(tmp_path / "none"), "x"]) == 1
    assert "Error: No index found" in capsys.readouterr().out
