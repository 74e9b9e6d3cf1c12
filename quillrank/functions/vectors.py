"""Vector arithmetic on array columns, always in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillrank.functions.lets import let


def _doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def l2_norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(_doubles(vector), F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalize(vector: Column) -> Column:
    """Unit-length copy; a zero vector stays as it is."""
    return let(l2_norm(vector), lambda norm: F.when(norm == 0.0, _doubles(vector)).otherwise(
        F.transform(_doubles(vector), lambda x: x / norm)
    ))


def dot(left: Column, right: Column) -> Column:
    """Inner product; equals the cosine when both sides have unit length."""
    products = F.zip_with(_doubles(left), _doubles(right), lambda a, b: a * b)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)
