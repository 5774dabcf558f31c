"""Filters on file tables: ignore rules, folders to skip, and project settings.

A handful of patterns becomes one regular expression, so each filter is a predicate
evaluated where the rows are: no join and no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import glob_regex, in_folder
from ..settings import BUNDLE_FOLDER


def _alternatives(patterns: Sequence[str]) -> str:
    """Any of the patterns.  A rule ending in '/' is tested against the path with a '/'
    added, so it stands for the same text without its last character."""
    bare = dict.fromkeys(p[:-1] if p.endswith("/") else p for p in patterns)
    return "|".join(glob_regex(p) for p in bare if p)


def matches_rule(rel_path: Column | str, patterns: Sequence[str]) -> Column:
    """The whole path matches a rule; '*' crosses '/' and case matters."""
    rel_path = F.col(rel_path) if isinstance(rel_path, str) else rel_path
    any_rule = _alternatives(patterns)
    return rel_path.rlike(rf"^(?s:{any_rule})\z") if any_rule else F.lit(False)


def below_ignored(rel_path: Column | str, patterns: Sequence[str]) -> Column:
    """A folder above the file, or the root itself (as '.'), matches a rule.

    The folders above a file are the parts of its path that end before a '/', so a rule
    that matches up to some '/' matches one of them.
    """
    rel_path = F.col(rel_path) if isinstance(rel_path, str) else rel_path
    any_rule = _alternatives(patterns)
    if not any_rule:
        return F.lit(False)
    return rel_path.rlike(f"^(?s:{any_rule})/") | matches_rule(F.lit("."), patterns)


def ignored(rel_path: Column | str, patterns: Sequence[str]) -> Column:
    return matches_rule(rel_path, patterns) | below_ignored(rel_path, patterns)


def drop_ignored(
    files: DataFrame, patterns: Sequence[str], rel_path: str = "rel_path"
) -> DataFrame:
    return files.filter(~ignored(rel_path, patterns))


def visited(
    files: DataFrame, patterns: Sequence[str], folder: str = BUNDLE_FOLDER
) -> DataFrame:
    """Files of all kinds in the folders the bundler walks through."""
    return files.filter(~below_ignored("rel_path", patterns) & ~in_folder("dir", folder))


def bundle_inputs(
    files: DataFrame, patterns: Sequence[str], suffix: str = ".py",
    folder: str = BUNDLE_FOLDER,
) -> DataFrame:
    """What the bundler reads: files of one suffix, not ignored, not its own output."""
    return drop_ignored(
        files.filter(F.col("name").endswith(suffix) & ~in_folder("dir", folder)), patterns
    )


def excluded_component(rel_path: Column | str, patterns: Sequence[str]) -> Column:
    """One component of the path matches a name or glob."""
    rel_path = F.col(rel_path) if isinstance(rel_path, str) else rel_path
    if not patterns:
        return F.lit(False)
    any_name = "|".join(glob_regex(p, "[^/]") for p in dict.fromkeys(patterns))
    return rel_path.rlike(rf"(^|/)({any_name})(/|\z)")


def project_filter(
    files: DataFrame,
    extensions: Sequence[str],
    excluded: Sequence[str],
    max_size: int,
) -> DataFrame:
    """Files a project includes, decided by name and size before any file is opened."""
    return files.filter(
        F.col("ext").isin(list(extensions))
        & (F.col("size") <= max_size)
        & ~excluded_component("rel_path", excluded)
    )
