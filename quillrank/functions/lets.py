"""Bind a sub-expression once so that lambdas do not evaluate it per element."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed a single time per row."""
    return F.element_at(F.transform(F.array(value), body), 1)
