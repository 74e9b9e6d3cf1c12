"""Approximate nearest neighbours by a permutation index.

Pivots are a bounded sample of the vectors. Every vector is represented by its
nearest pivots in order, and posted in the inverted files of the first ``posts``
of them. A query visits the files of its own first ``probes`` pivots, ranks what is
posted there by Spearman's footrule between the two orders, and compares the best
``candidates`` of each file part by their true inner products. Long files are cut
into parts, so a pivot that is near to very many vectors is spread over tasks.

Nearness is the largest inner product. For the orders, vectors get one more
component that makes their lengths equal, so that near in angle means large in
product. Queries for which too few vectors are found visit every file once more,
without the cut by footrule, and are then exact.

Defined results: vectors that are null, zero, or hold null or non-finite components
take no part, nor do vectors of another length than the most common one (ties:
the longer). A null id takes no part. Repeated rows count once; rows with the same
id and different vectors are one query and can be found with either score. A query
does not find rows of its own id. Ties in the score go to the smaller id.
Fewer candidates than asked for are all returned. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillrank.llm.tables import written


@dataclass(frozen=True)
class PermutationConfig:
    """``pivots``: size of the sample. ``posts``, ``probes``: files of a vector and of a query.

    From each part of a file a query compares ``share`` of the rows, ``candidates``
    at least. ``part_rows`` and ``part_queries`` bound what one call compares. The
    defaults are for vectors without much structure; recall is measured in tests.
    """

    k: int = 20
    query_every: int = 20
    pivots: int = 128
    posts: int = 6
    probes: int = 28
    candidates: int = 128
    share: float = 0.08
    part_rows: int = 8192
    part_queries: int = 2048
    seed: int = 11


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, v``: the vectors that take part, as doubles."""
    v = F.col("embedding").cast("array<double>")
    fine = (
        F.col("vec_id").isNotNull() & v.isNotNull()
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        & F.exists(v, lambda x: x != 0)
    )
    rows = vectors.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return rows.where(F.size("v") == F.lit(sizes[0]["n"] if sizes else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    """An Arrow list column of equal lengths as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _packed(x: np.ndarray) -> pa.Array:
    """Rows of a matrix as byte strings."""
    width = x.dtype.itemsize * x.shape[1]
    offsets = np.arange(len(x) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(x))])


def _unpacked(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    raw = b"".join(x.as_buffer() for x in column)
    return np.frombuffer(raw, kind).reshape(len(column), -1)


def pivot_orders(x: np.ndarray, pivots: np.ndarray, top: float) -> np.ndarray:
    """Numbers of the pivots of each row, nearest first, ties by number.

    ``top`` is the largest squared length of any vector.
    """
    rest = np.sqrt(np.maximum(top - (x * x).sum(1), 0.0))
    own = np.sqrt(np.maximum(top - (pivots * pivots).sum(1), 0.0))
    near = x @ pivots.T + rest[:, None] * own[None, :]
    return np.argsort(-np.round(near, 12), axis=1, kind="stable")


def places(orders: np.ndarray) -> np.ndarray:
    """The place of each pivot in the order of each row."""
    kind = np.uint8 if orders.shape[1] <= 256 else np.uint16
    out = np.empty(orders.shape, kind)
    np.put_along_axis(out, orders, np.arange(orders.shape[1], dtype=kind)[None, :], 1)
    return out


def footrule(query: np.ndarray, posted: np.ndarray) -> np.ndarray:
    """Spearman's footrule between the places of one row and those of many."""
    return (np.maximum(posted, query) - np.minimum(posted, query)).sum(1, dtype=np.uint32)


def inner_products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Products of the rows with one vector, added up component by component.

    The order of the additions is the same for every row, so equal vectors give
    equal values.
    """
    out = np.zeros(len(x))
    for column, factor in zip(np.ascontiguousarray(x.T), y):
        out += column * factor
    return out


def _orders(rows: DataFrame, cfg: PermutationConfig, shared) -> DataFrame:
    """Rows as bytes, with the places of all pivots and the numbers of the nearest ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, top = shared.value
        for batch in batches:
            x = _matrix(batch.column("v"))
            if len(x):
                order = pivot_orders(x, pivots, top)
                first = order[:, : max(cfg.posts, cfg.probes)].astype(np.int32)
                yield pa.RecordBatch.from_pydict({
                    "vec_id": batch.column("vec_id"), "v": _packed(x), "places": _packed(places(order)),
                    "first": pa.array(list(first), pa.list_(pa.int32())),
                })

    return rows.mapInArrow(run, "vec_id long, v binary, places binary, first array<int>")


def _search(postings: DataFrame, visits: DataFrame, cfg: PermutationConfig, pivots: int, cut: bool) -> DataFrame:
    """``query_id, vec_id, score``: the best of every part of a file for every query that visits it."""
    kind = np.uint8 if pivots <= 256 else np.uint16

    def compare(posted: pa.Table, asked: pa.Table) -> pa.Table:
        who = np.zeros(0, np.int64)
        ids = who
        score = np.zeros(0)
        if len(posted) and len(asked):
            posted = posted.sort_by("vec_id")
            numbers, x = posted.column("vec_id").to_numpy(), _unpacked(posted.column("v"), np.float64)
            asking, y = asked.column("query_id").to_numpy(), _unpacked(asked.column("y"), np.float64)
            there, here = _unpacked(posted.column("places"), kind), _unpacked(asked.column("own_places"), kind)
            most = max(cfg.candidates, int(np.ceil(cfg.share * len(numbers)))) if cut else len(numbers)
            out = []
            for q in range(len(asking)):
                near = np.arange(len(numbers))
                if most < len(numbers):
                    # Rows are in the order of their ids, which breaks ties.
                    near = np.sort(np.argsort(footrule(here[q], there), kind="stable")[:most])
                near = near[numbers[near] != asking[q]]
                product = inner_products(x[near], y[q])
                best = np.lexsort((numbers[near], -product))[: cfg.k]
                out.append((np.full(len(best), asking[q]), numbers[near[best]], product[best]))
            who, ids, score = (np.concatenate(c) for c in zip(*out))
        return pa.table({"query_id": who, "vec_id": ids, "score": score})

    key = ["pivot", "part", "asked"]
    return postings.groupBy(*key).cogroup(visits.groupBy(*key)).applyInArrow(
        compare, "query_id long, vec_id long, score double"
    )


def _posted(indexed: DataFrame, posts: int) -> DataFrame:
    return indexed.select("vec_id", "v", "places", F.explode(F.slice("first", 1, posts)).alias("pivot"))


def _parts(postings: DataFrame, asked: DataFrame, cfg: PermutationConfig) -> tuple[DataFrame, DataFrame]:
    """Cut long files and long lists of visitors; every part of one meets every part of the other."""
    n = postings.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / cfg.part_rows).cast("int").alias("parts"))
    m = asked.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / cfg.part_queries).cast("int").alias("lists"))
    grid = written(n.join(m, "pivot"), "pivot-parts")
    spread = lambda c, n: F.pmod(F.xxhash64("_row", F.lit(cfg.seed)), F.col(n)).cast("int").alias(c)
    p = postings.withColumn("_row", F.xxhash64("vec_id", "v")).join(grid, "pivot").select(
        "vec_id", "v", "places", "pivot", spread("part", "parts"), F.explode(F.sequence(F.lit(0), F.col("lists") - 1)).alias("asked")
    )
    q = asked.withColumn("_row", F.xxhash64("query_id", "v")).join(grid, "pivot").select(
        "query_id", F.col("v").alias("y"), F.col("places").alias("own_places"), "pivot", spread("asked", "lists"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    )
    return p, q


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each query from the best of the parts, each found vector once."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, cfg: PermutationConfig = PermutationConfig()) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows whose id is divisible by ``query_every``."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    total = rows.agg(
        F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("top"),
        F.countDistinct("vec_id").alias("ids"),
    ).first()
    if not total["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # Different vectors only: copies of one would make the same pivot several times.
    sample = rows.select("v").distinct().orderBy(F.xxhash64("v", F.lit(cfg.seed)), "v").limit(cfg.pivots).collect()
    pivots = np.array([r["v"] for r in sample], float)
    shared = spark.sparkContext.broadcast((pivots, float(total["top"])))
    indexed = written(_orders(rows, cfg, shared), "permutations")

    queries = indexed.where(F.col("vec_id") % cfg.query_every == 0).withColumnRenamed("vec_id", "query_id")
    visits = queries.select("query_id", "v", "places", F.explode(F.slice("first", 1, cfg.probes)).alias("pivot"))
    found = _merged(_search(*_parts(_posted(indexed, cfg.posts), visits, cfg), cfg, len(pivots), True), cfg.k)
    found = written(found, "neighbours")

    # Queries with too few: everything is posted once, every file is visited, nothing is cut.
    others = min(cfg.k, total["ids"] - 1)
    full = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= others).select("query_id")
    short = queries.join(full, "query_id", "left_anti")
    if short.isEmpty():
        return found.select("query_id", "rank", "vec_id", "score")
    again = short.withColumn("pivot", F.explode(F.sequence(F.lit(0), F.lit(len(pivots) - 1))))
    rest = _merged(_search(*_parts(_posted(indexed, 1), again, cfg), cfg, len(pivots), False), cfg.k)
    kept = found.join(full, "query_id", "left_semi")
    return kept.select("query_id", "rank", "vec_id", "score").union(rest.select("query_id", "rank", "vec_id", "score"))
