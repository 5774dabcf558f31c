"""Ignore rules of a folder and project settings."""

from __future__ import annotations

import posixpath

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from .filetree import open_folder

IGNORE_FILE = ".gitignore"

PROJECT_SCHEMA = """
    id STRING, name STRING, root_path STRING,
    settings STRUCT<
        llm_name STRING, temperature DOUBLE, chunk_size INT, chunk_overlap INT,
        included_extensions ARRAY<STRING>, excluded_patterns ARRAY<STRING>,
        max_file_size BIGINT, index_update_frequency STRING>,
    created_at TIMESTAMP, updated_at TIMESTAMP
    """


def ignore_rules(root: str) -> list[str]:
    """Patterns of the ignore files in root and every folder above it, nearest first.

    A handful of small files: read on the driver.  Lines are stripped; blank lines and
    lines whose first character is '#' are no patterns, but '  # x' is one.
    """
    system, folder = open_folder(root)
    rules: list[str] = []
    while True:
        path = posixpath.join(folder, IGNORE_FILE)
        if system.get_file_info(path).type == fs.FileType.File:
            with system.open_input_stream(path, compression=None) as stream:
                text = stream.read().decode("utf-8")
            lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
            rules += [s.strip() for s in lines if s.strip() and not s.startswith("#")]
        above = posixpath.dirname(folder)
        if above == folder or not above:
            return rules
        folder = above


def rules_table(spark: SparkSession, rules: list[str]) -> DataFrame:
    rows = [(i, p) for i, p in enumerate(rules, 1)]
    return spark.createDataFrame(rows, "rule_no int, pattern string")


def read_projects(spark: SparkSession, path: str) -> DataFrame:
    """One row per project of a JSON array file."""
    return spark.read.schema(PROJECT_SCHEMA).option("multiLine", True).json(path)
