"""Vector functions on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """dot / (|a| |b|); null on unequal lengths or a zero norm."""
    left, right = _col(a), _col(b)
    lengths = norm(left) * norm(right)
    return F.when((F.size(left) == F.size(right)) & (lengths > 0), dot(left, right) / lengths)


def cosine_or_zero(a: Column | str, b: Column | str) -> Column:
    return F.coalesce(cosine(a, b), F.lit(0.0))


def parse_vector(text: Column | str) -> Column:
    """``[a,b,c]`` to array<double>; blank or null gives an empty array."""
    c = _col(text)
    empty = F.array().cast("array<double>")
    return F.when(c.isNull() | (F.trim(c) == ""), empty).otherwise(F.from_json(c, "array<double>"))


def format_vector(vector: Column | str) -> Column:
    """array to ``[a,b,c]``."""
    parts = F.array_join(_col(vector).cast("array<string>"), ",")
    return F.concat(F.lit("["), parts, F.lit("]"))
