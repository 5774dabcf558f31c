"""Column functions on vectors (ARRAY<FLOAT>), computed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METHODS = ("cosine", "dot", "euclidean")


def _double(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return _total(F.zip_with(_double(a), _double(b), lambda x, y: x * y))


def norm(a: Column | str) -> Column:
    return F.sqrt(_total(F.transform(_double(a), lambda x: x * x)))


def squared_l2(a: Column | str, b: Column | str) -> Column:
    """The distance of the index: squared, ascending, never negative."""
    return _total(
        F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y))
    )


def cosine(a: Column | str, b: Column | str) -> Column:
    """NULL where one of the vectors is all zeros."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def euclidean(a: Column | str, b: Column | str) -> Column:
    """The negative distance, so that bigger is closer."""
    return -F.sqrt(squared_l2(a, b))


def same_size(a: Column | str, b: Column | str, value: Column) -> Column:
    """The value, an error where sizes differ: zip_with alone would pad with NULL."""
    x, y = (F.col(v) if isinstance(v, str) else v for v in (a, b))
    return F.when(
        F.size(x) != F.size(y), F.raise_error("vectors differ in dimension").cast("double")
    ).otherwise(value)


def check_method(method: str) -> str:
    if method not in METHODS:
        raise ValueError(
            f"Invalid similarity method '{method}'. "
            f"Must be one of: {', '.join(repr(m) for m in METHODS)}"
        )
    return method


def similarity(a: Column | str, b: Column | str, method: str = "cosine") -> Column:
    """Score of two vectors, bigger is closer; NULL for a NULL vector, an error if sizes differ."""
    check_method(method)
    return same_size(a, b, {"cosine": cosine, "dot": dot, "euclidean": euclidean}[method](a, b))


def normalize(a: Column | str) -> Column:
    """The vector scaled to length one; NULL entries for the zero vector."""
    v = _double(a)
    # Bound by an outer lambda: inside the inner one it would be computed per entry.
    scaled = F.transform(
        F.array(norm(v)), lambda length: F.transform(v, lambda x: F.try_divide(x, length))
    )
    return F.element_at(scaled, 1)
