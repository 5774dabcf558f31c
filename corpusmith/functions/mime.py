"""MIME type of a file name.

The map comes from the interpreter's standard library (without the machine's own
files), so it is small, fixed, and the same on every executor.
"""

from __future__ import annotations

import mimetypes

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..settings import DEFAULT_MIME

# The last dot and what follows; leading dots are part of the name.
_LAST_EXT = r"^\.*[^.].*?(\.[^.]*)$"


def _standard() -> mimetypes.MimeTypes:
    return mimetypes.MimeTypes(filenames=())


def mime_rows() -> list[tuple[str, str]]:
    """(extension in lower case, type), sorted."""
    return sorted(_standard().types_map[True].items())


def compound_rows() -> list[tuple[str, str]]:
    """(short ending, the two endings it stands for), as '.tgz' for '.tar.gz'."""
    return sorted(_standard().suffix_map.items())


def encodings() -> list[str]:
    """Endings that name a compression; the type is that of the name before them."""
    return sorted(_standard().encodings_map)


def type_extension(name: Column | str) -> Column:
    """The ending that decides the type, in lower case; '' for none."""
    name = F.col(name) if isinstance(name, str) else name
    last = F.regexp_extract(name, _LAST_EXT, 1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    # '.tgz' counts as '.tar.gz': the type is that of the first of the two.
    kind = F.when(last.isin(encodings()), F.regexp_extract(stem, _LAST_EXT, 1))
    for short, both in compound_rows():
        kind = kind.when(F.lower(last) == short, F.lit(both[: both.index(".", 1)]))
    return F.lower(kind.otherwise(last))


def with_mime_type(files: DataFrame, name: str = "name", out: str = "mime") -> DataFrame:
    """Left join with the fixed map; unknown endings get the default type."""
    spark = files.sparkSession
    table = spark.createDataFrame(mime_rows(), "_ext string, _mime string")
    return (
        files.withColumn("_ext", type_extension(name))
        .join(F.broadcast(table), "_ext", "left")
        .withColumn(out, F.coalesce("_mime", F.lit(DEFAULT_MIME)))
        .drop("_ext", "_mime")
    )
