"""Vector codes: product codebooks learned by active-entry Lloyd rounds in integers.

A vector is floored to integers and cut into equal parts; each part position has a
codebook. A round assigns every part to the nearest entry and moves each entry to
the floored mean of its parts. Between rounds a row keeps its entry and the exact
squared distance to it. Where that entry stayed as it was, the distance still holds and
no other resting entry can have become nearer, so only the entries that moved
are compared with it. Parts whose own entry moved look at all entries again. Both give
what a full scan gives, the lower index on ties included.

Every round is one pass: rows go in with the state of the round before and come
out with the new one, and each task adds one row with the counts and sums of its
parts. The written table is the state of the next round, so a lost executor costs
only its tasks; the table before it is removed. The driver sees codebooks alone.

Defined results: a row takes no part if its vector is null or empty, holds a null or a
non-finite component, or has another length than the vector of the smallest id.
Rows with equal ids are rows of their own; first entries are taken by id (null last),
then by components. Fewer rows than entries give fewer entries. A length that cannot
be cut into equal parts, or components whose integers do not fit 28 bits, are refused
with an error. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.llm.tables import new_folder, written
from quillrank.sources.workspace import discard

#: Integers below this keep a squared distance within a long for any sensible width.
_LARGEST = 1 << 28
#: Label sums up to this many rows are copied to the tasks; one is a few dozen bytes.
_SMALL = 100_000
_SALTS = 32


@dataclass(frozen=True)
class CodebookConfig:
    """``scale`` is what components are multiplied by before they are floored."""

    parts: int = 8
    entries: int = 16
    rounds: int = 6
    scale: float = 4096.0


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, vector`` of the rows that take part, whatever else the table has."""
    component = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    vector = F.col("embedding").cast("array<double>")
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", vector.alias("vector")).where(
        F.col("vector").isNotNull() & (F.size("vector") > 0) & F.forall("vector", component)
    )


def floored(values: np.ndarray, scale: float) -> np.ndarray:
    scaled = np.floor(values * scale)
    if len(scaled) and np.abs(scaled).max() >= _LARGEST:
        raise ValueError(f"a component is too large for codes: {np.abs(values).max()}")
    return scaled.astype(np.int32)


def scan_entries(points: np.ndarray, book: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest of the entries ``which`` (ascending) for every point, and its exact squared distance."""
    best = np.full(len(points), np.iinfo(np.int64).max)
    index = np.full(len(points), -1)
    for e in which:
        off = points - book[e]
        distance = np.einsum("ij,ij->i", off, off)
        nearer = distance < best
        best[nearer], index[nearer] = distance[nearer], e
    return index, best


def assign_part(points: np.ndarray, book: np.ndarray, moved: np.ndarray,
                held: np.ndarray | None, distance: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Entries and distances of one part position after the entries ``moved`` have changed.

    ``held`` and ``distance`` are those of the round before, or None in the first.
    """
    everything = np.arange(len(book))
    if held is None:
        return scan_entries(points, book, everything)
    held, distance = held.astype(np.int64), distance.copy()
    active = moved[held]
    again = np.flatnonzero(active)
    if len(again):
        held[again], distance[again] = scan_entries(points[again], book, everything)
    resting = np.flatnonzero(~active)
    if len(resting) and moved.any():
        index, best = scan_entries(points[resting], book, np.flatnonzero(moved))
        better = (best < distance[resting]) | ((best == distance[resting]) & (index < held[resting]))
        held[resting[better]], distance[resting[better]] = index[better], best[better]
    return held, distance


def _fixed(column: pa.Array, kind: str, width: int) -> np.ndarray:
    """Binary values of one length as rows of numbers."""
    flat = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return flat[ends[0] : ends[-1]].view(kind).reshape(len(column), width)


def _binary(rows: np.ndarray) -> pa.Array:
    flat = np.ascontiguousarray(rows)
    ends = np.arange(len(rows) + 1, dtype=np.int32) * (flat.shape[1] * flat.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(flat.tobytes())])


def _round_pass(books: np.ndarray, moved: np.ndarray, first: bool, cfg: CodebookConfig):
    """Task function of one round: new state rows, then one row with counts and sums."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts, entries, width + 1), np.int64)
        seen, schema = False, None
        for batch in batches:
            if not batch.num_rows:
                continue
            seen, n = True, batch.num_rows
            if first:
                vectors = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(n, parts * width)
                ints, codes, distances = floored(vectors, cfg.scale), None, None
            else:
                ints = _fixed(batch.column("ints"), "<i4", parts * width)
                codes = _fixed(batch.column("codes"), "u1", parts)
                distances = _fixed(batch.column("distances"), "<i8", parts)
            new_codes, new_distances = np.zeros((n, parts), np.uint8), np.zeros((n, parts), np.int64)
            for p in range(parts):
                points = ints[:, p * width : (p + 1) * width].astype(np.int64)
                index, best = assign_part(points, books[p], moved[p], None if first else codes[:, p],
                                          None if first else distances[:, p])
                new_codes[:, p], new_distances[:, p] = index, best
                order = np.argsort(index, kind="stable")
                starts = np.searchsorted(index[order], np.arange(entries))
                filled = np.flatnonzero(np.diff(np.append(starts, n)))
                sums[p, filled, :width] += np.add.reduceat(points[order], starts[filled])
                sums[p, filled, width] += np.diff(np.append(starts, n))[filled]
            out = pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), _binary(ints.astype("<i4")), _binary(new_codes),
                 _binary(new_distances.astype("<i8")), pa.nulls(n, pa.binary())],
                ["vec_id", "label", "ints", "codes", "distances", "sums"])
            schema = out.schema
            yield out
        if seen:
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, f.type) for f in schema][:-1] + [pa.array([sums.tobytes()], pa.binary())], schema=schema)

    return run


def _added(sums: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """Sum of the tasks' rows; they are added up in tasks, the driver adds one for each of those."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(int(np.prod(shape)), np.int64)
        for batch in batches:
            for raw in batch.column("sums"):
                total += np.frombuffer(raw.as_buffer(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    total = np.zeros(shape, np.int64)
    for row in sums.mapInArrow(add, "sums binary").collect():
        total += np.frombuffer(bytes(row["sums"]), np.int64).reshape(shape)
    return total


@dataclass(frozen=True)
class Codes:
    """``rows`` is ``vec_id, label, code, error``; ``books`` has one codebook for each part."""

    rows: DataFrame
    books: np.ndarray


def fit_codes(vectors: DataFrame, cfg: CodebookConfig = CodebookConfig()) -> Codes:
    """Learn codebooks over all rows and code every one of them."""
    spark = vectors.sparkSession
    points = usable(vectors)
    seeds = points.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select("vector").limit(cfg.entries).collect()
    length = len(seeds[0]["vector"]) if seeds else 0
    if length % cfg.parts:
        raise ValueError(f"vectors of {length} components cannot be cut into {cfg.parts} equal parts")
    label = vectors.schema["label"].dataType.simpleString()
    state = f"vec_id long, label {label}, ints binary, codes binary, distances binary, sums binary"
    if not seeds:
        return Codes(spark.createDataFrame([], f"vec_id long, label {label}, code string, error long"),
                     np.zeros((cfg.parts, 0, 0), np.int64))
    points, width = points.where(F.size("vector") == length), length // cfg.parts
    # The seeds of another length left no row, so the first ones are taken again among the rest.
    if any(len(row["vector"]) != length for row in seeds):
        seeds = points.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select("vector").limit(cfg.entries).collect()
    books = floored(np.array([row["vector"] for row in seeds]), cfg.scale).astype(np.int64)
    books = np.ascontiguousarray(books.reshape(len(seeds), cfg.parts, width).transpose(1, 0, 2))
    moved = np.ones(books.shape[:2], bool)
    rows, before = points, None
    for round_number in range(cfg.rounds + 1):
        path = new_folder(spark, "codebook-round")
        rows.mapInArrow(_round_pass(books, moved, round_number == 0, cfg), state).write.parquet(path)
        table = spark.read.schema(state).parquet(path)
        if before:
            discard(spark, before)
        rows, before = table.where(F.col("sums").isNull()), path
        if round_number < cfg.rounds:
            total = _added(table.where(F.col("sums").isNotNull()).select("sums"), (*books.shape[:2], width + 1))
            count = total[:, :, width:]
            following = np.where(count > 0, total[:, :, :width] // np.maximum(count, 1), books)
            moved, books = (following != books).any(axis=2), following
    return Codes(rows.mapInArrow(_coded(cfg.parts), f"vec_id long, label {label}, code string, error long"), books)


def _coded(parts: int):
    digits = np.array([f"{i:02x}" for i in range(256)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes = _fixed(batch.column("codes"), "u1", parts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), batch.column("label"),
                     pa.array(np.ascontiguousarray(digits[codes]).view(f"<U{2 * parts}").ravel(), pa.string()),
                     pa.array(_fixed(batch.column("distances"), "<i8", parts).sum(axis=1), pa.int64())],
                    ["vec_id", "label", "code", "error"])

    return run


def books_sha256(books: np.ndarray) -> str:
    """Digest of all entries as decimal integers by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def code_vectors(vectors: DataFrame, cfg: CodebookConfig = CodebookConfig()) -> DataFrame:
    """``vec_id, label, code, error, label_error, codebooks_sha256`` for every row that takes part.

    ``label_error`` is the error of all rows with the same label, nulls together.
    Errors are summed in each task first. Few labels are copied to the tasks; with many
    of them both sides are shuffled and the rows of a label spread over several tasks.
    """
    found = fit_codes(vectors, cfg)
    rows = written(found.rows, "vector-codes")
    sums = written(rows.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), "label-errors")
    same = F.col("label").eqNullSafe(F.col("_label"))
    fixed_width = vectors.schema["label"].dataType.typeName() in ("byte", "short", "integer", "long", "boolean", "date")
    if fixed_width and sums.count() <= _SMALL:
        joined = rows.join(F.broadcast(sums), same)
    else:
        salt = F.pmod(F.xxhash64("vec_id", "code"), F.lit(_SALTS)).cast("int")
        copies = sums.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
        joined = rows.withColumn("_salt", salt).join(copies, same & (F.col("_salt") == F.col("_copy")))
    return joined.select("vec_id", "label", "code", "error", "label_error",
                         F.lit(books_sha256(found.books)).alias("codebooks_sha256"))
