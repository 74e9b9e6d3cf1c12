"""Cache keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decimal_text(value: Column) -> Column:
    """Shortest decimal text of a number in 0..1: ``0.02``, ``0.0005``, ``1e-05``."""
    text = value.cast("string")
    plain = F.rtrim(value.cast("decimal(38,20)").cast("string"), F.lit("0"))
    mantissa = F.regexp_extract(text, r"^(.+?)(?:\.0)?E-", 1)
    exponent = F.lpad(F.regexp_extract(text, r"E-(\d+)$", 1), 2, "0")
    return (
        F.when((value == 0.0) | (value >= 1e-3), text)
        .when(value >= 1e-4, plain)
        .otherwise(F.concat(mantissa, F.lit("e-"), exponent))
    )


def _hashed(prefix: str, raw: Column, namespace: str | None) -> Column:
    scoped = raw if namespace is None else F.concat(F.lit(namespace + "|"), raw)
    return F.concat(F.lit(prefix), F.sha2(scoped, 256))


def embedding_key(text: Column, namespace: str | None = None) -> Column:
    """Key of a memoised embedding. ``namespace`` tells models apart."""
    return _hashed("emb:", text, namespace)


def results_key(q: Column, limit: Column, threshold: Column, namespace: str | None = None) -> Column:
    """Key of a memoised result list. ``namespace`` tells model and rerank settings apart."""
    raw = F.concat_ws("|", q, limit.cast("string"), decimal_text(threshold))
    return _hashed("res:", raw, namespace)
