"""Vector arithmetic on array<double> columns. Scores are in double precision whatever the input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double(v: Column | str) -> Column:
    return _col(v).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(_col(v), F.lit(0.0), lambda s, x: s + x * x))


def unit(v: Column | str) -> Column:
    """The vector over its length; a zero or non-finite length is an error, not a null."""
    n = norm(v)
    checked = F.when((n > 0) & (n < float("inf")), n).otherwise(F.raise_error(F.lit("a vector has no direction")).cast("double"))
    return F.transform(_col(v), lambda x: x / checked)


def cosine(a: Column | str, b: Column | str) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def clipped(x: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))
