"""From a folder of files to bundles or to an index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession

from ..operators.bundle import PART_BYTES, bundles, make_folders, write_bundles
from ..operators.corpus import load_status
from ..operators.embedding import Embedder
from ..operators.ignore import bundle_inputs, project_filter, visited
from ..session import cut_lineage
from ..settings import ERROR_PREFIX, Settings
from ..sources.filetree import as_documents, folder_exists, list_files, read_bodies
from ..sources.rules import ignore_rules
from .index import Index, build_index


def bundle_tree(spark: SparkSession, root: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """Writes the bundles of all folders below root; (out_path, n_files) per file.

    Hidden folders take part unless a rule says otherwise; line ends become '\\n'.
    """
    rules = ignore_rules(root)
    everything = list_files(spark, root, include_hidden=True)
    make_folders(visited(everything, rules), root)
    listing = bundle_inputs(everything, rules)
    files = read_bodies(listing, universal_newlines=True)
    # Written once, whatever the caller does with the report.
    return cut_lineage(write_bundles(bundles(files, listing, part_bytes), root))


def index_tree(
    spark: SparkSession, root: str, path: str, settings: Settings | None = None,
    embedder: Embedder | None = None,
) -> tuple[Index | None, str, str]:
    """Indexes the files of a folder: (index, status, message).

    A missing or empty folder and a failure are answers, not exceptions.
    """
    settings = settings or Settings()
    try:
        if not folder_exists(root):
            return (None, *load_status(None))
        return _index(spark, list_files(spark, root, settings.recursive), path, settings, embedder)
    except Exception as e:
        return None, "error", f"{ERROR_PREFIX}{e}"


def project_settings(project: Row) -> Settings:
    """The options of one row of the project table."""
    s = project["settings"]
    return Settings(chunk_size=s["chunk_size"], chunk_overlap=s["chunk_overlap"])


def project_files(spark: SparkSession, project: Row, base: str = ".") -> DataFrame:
    """Names of the files a project includes; its root is relative to base."""
    s = project["settings"]
    root = project["root_path"]
    root = root if root.startswith("/") or "://" in root else f"{base.rstrip('/')}/{root}"
    return project_filter(
        list_files(spark, root, include_hidden=True),
        s["included_extensions"], s["excluded_patterns"], s["max_file_size"],
    )


def index_project(
    spark: SparkSession, project: Row, path: str, base: str = ".",
    embedder: Embedder | None = None,
) -> tuple[Index | None, str, str]:
    """Indexes the files a project includes, with the project's chunk sizes."""
    files = project_files(spark, project, base)
    return _index(spark, files, path, project_settings(project), embedder)


def _index(
    spark: SparkSession, listing: DataFrame, path: str, settings: Settings,
    embedder: Embedder | None,
) -> tuple[Index | None, str, str]:
    if listing.isEmpty():
        return (None, *load_status(0))
    index = build_index(as_documents(read_bodies(listing)), path, settings, embedder)
    found = index.info().first()["n_documents"]
    return (index if found else None, *load_status(found))
