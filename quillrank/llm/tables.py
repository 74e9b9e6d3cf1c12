"""Small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrank.sources.workspace import new_folder, store  # noqa: F401  used by operators

NO_ID = -(2**63)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back."""
    return store(df, label).df


def text_rows(documents: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, whatever else the table has."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def row_key() -> list[Column]:
    """Two longs that identify a document: its id (nulls have one of their own) and a hash of its text.

    Rows with the same id and text are the same document, repeated.
    """
    return [
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id"),
        F.xxhash64(F.col("text")).alias("_tx"),
    ]


def remainder(modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null ids give null."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def summed_vectors(parts: DataFrame, width: int) -> dict[str, np.ndarray]:
    """Sum of int64 vectors given in pieces: rows (kind, piece, counts as bytes).

    Pieces of one kind and number meet in one task, which adds them as they
    stream by. The result has one vector for each kind and goes to the driver.
    """
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            for kind, piece, raw in zip(*(batch.column(i).to_pylist() for i in range(3))):
                counts = np.frombuffer(raw, np.int64)
                if (kind, piece) in sums:
                    sums[kind, piece] += counts
                else:
                    sums[kind, piece] = counts.copy()
        if sums:
            yield pa.RecordBatch.from_pydict({
                "kind": [k for k, _ in sums], "piece": pa.array([p for _, p in sums], pa.int32()),
                "counts": pa.array([v.tobytes() for v in sums.values()], pa.binary()),
            })

    schema = "kind string, piece int, counts binary"
    found: dict[str, np.ndarray] = {}
    for row in parts.repartition("kind", "piece").mapInArrow(add, schema).collect():
        vector = found.setdefault(row["kind"], np.zeros(width, np.int64))
        counts = np.frombuffer(bytes(row["counts"]), np.int64)
        start = row["piece"] * len(counts)
        vector[start : start + len(counts)] += counts
    return found


def vector_pieces(sums: dict[str, np.ndarray], pieces: int) -> pa.RecordBatch:
    """Rows (kind, piece, counts) for ``summed_vectors``."""
    rows = [(k, i, part.tobytes()) for k, v in sums.items() for i, part in enumerate(np.split(v, pieces)) if part.any()]
    return pa.RecordBatch.from_pydict({
        "kind": pa.array([r[0] for r in rows], pa.string()), "piece": pa.array([r[1] for r in rows], pa.int32()),
        "counts": pa.array([r[2] for r in rows], pa.binary()),
    })
