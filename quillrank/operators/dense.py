"""Nearest neighbours of query vectors.

The exact search copies one block of queries to the tasks that read the documents, which
do not move. More queries make it a grid: documents are cut into slices, queries into blocks, and
each slice meets each block in one group, which keeps the best ``k`` documents of every
query; only those few rows are merged. Both have a bounded size, and any number of
queries is one job.

The approximate search reads only the cells that some query probes. Cells are cut
into slices of bounded size, and so are the queries of a cell; every slice meets the
queries that probe its cell in one group and is multiplied with those alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrank.config import MAX_DEPTH, RetrievalConfig
from quillrank.functions.vectors import dot
from quillrank.operators.topk import top_k
from quillrank.sources.workspace import store

_SCORED = "query_id string, doc_id string, score double"
#: Products held at once by a task.
_PRODUCTS = 4_000_000
#: Slices of the exact search are not cut finer than this.
_FEWEST_ROWS = 250


def _matrix(rows: pa.Table | pa.RecordBatch):
    """The vectors of some rows, one below the other."""
    column = rows.column("vector")
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(rows.num_rows, -1)


def _best(scored: DataFrame, depth: int) -> DataFrame:
    return top_k(scored, ["query_id"], [F.desc("score"), F.asc("doc_id")], depth).select(
        "query_id", "rank", "doc_id", "score")


def knn_exact(
    queries: DataFrame, vectors: DataFrame, cfg: RetrievalConfig, depth: int = MAX_DEPTH
) -> DataFrame:
    """Exact cosine neighbours: ``(query_id, rank, doc_id, score)``.

    ``queries`` is ``(query_id, vector)``, ``vectors`` is ``(doc_id, vector)``,
    both of unit length. A corpus with fewer than ``depth`` vectors is returned
    whole; a document without a vector is never found.
    """
    asked = store(queries.where(F.col("vector").isNotNull()).select("query_id", "vector"), "query-vectors")
    held = vectors.where(F.col("vector").isNotNull()).select("doc_id", "vector")
    if asked.rows <= cfg.query_block_rows:
        return _best(_scored_where_they_are(asked.df, held, depth, cfg), depth)
    rows, cores = vectors.count(), vectors.sparkSession.sparkContext.defaultParallelism
    # Small tables are cut finer, so that all cores have a part.
    slices = max(1, min(-(-rows // _FEWEST_ROWS), max(-(-rows // cfg.slice_rows), 2 * cores)))
    parts = max(1, -(-asked.rows // cfg.query_block_rows))
    part, piece = (F.pmod(F.xxhash64(key), F.lit(n)).cast("int") for key, n in (("query_id", parts), ("doc_id", slices)))
    left = asked.df.select("query_id", "vector", part.alias("part"), _upto(F.lit(slices)).alias("slice"))
    right = held.select("doc_id", "vector", piece.alias("slice"), _upto(F.lit(parts)).alias("part"))
    return _best(_scored(left, right, ["slice", "part"], depth, cfg), depth)


def _scored_where_they_are(queries: DataFrame, documents: DataFrame, depth: int, cfg: RetrievalConfig) -> DataFrame:
    """Best documents of each slice that a task reads, for one block of queries."""
    shared = documents.sparkSession.sparkContext.broadcast(queries.toArrow())
    score, rows = _score_group(depth, cfg.score_digits), cfg.slice_rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= rows:
                yield from score(shared.value, pa.Table.from_batches(held)).to_batches()
                held.clear()
        if held:
            yield from score(shared.value, pa.Table.from_batches(held)).to_batches()

    return documents.mapInArrow(run, _SCORED)


def knn_lsh(
    queries: DataFrame, vectors: DataFrame, cfg: RetrievalConfig, depth: int = MAX_DEPTH, *,
    bucket_length: float = 0.25, tables: int = 16, least: float = -1.0, seed: int = 42,
) -> DataFrame:
    """Approximate neighbours by locality-sensitive hashing: ``(query_id, rank, doc_id, score)``.

    Vectors are projected on ``tables`` random lines and fall into buckets of
    ``bucket_length``; pairs that share a bucket in one of them are joined and scored.
    Shorter buckets and fewer tables compare less and find less. ``least`` is the smallest
    similarity that counts. Nothing is stored or trained beforehand.
    """
    def hashed(rows: DataFrame, key: str) -> DataFrame:
        known = rows.where(F.col("vector").isNotNull())
        return known.select(key, "vector", array_to_vector(F.col("vector").cast("array<double>")).alias("features"))

    asked, held = hashed(queries, "query_id"), hashed(vectors, "doc_id")
    model = BucketedRandomProjectionLSH(
        inputCol="features", outputCol="hashes", bucketLength=bucket_length, numHashTables=tables, seed=seed,
    ).fit(held)
    # Of unit vectors; a little more, as the score decides in the end.
    distance = math.sqrt(max(0.0, 2.0 - 2.0 * least)) + 1e-4
    pairs = model.approxSimilarityJoin(asked, held, distance, "distance")
    scored = pairs.select(
        F.col("datasetA.query_id").alias("query_id"), F.col("datasetB.doc_id").alias("doc_id"),
        F.round(dot(F.col("datasetA.vector"), F.col("datasetB.vector")), cfg.score_digits).alias("score"),
    )
    return _best(scored.where(F.col("score") >= least), depth)


@dataclass(frozen=True)
class CellIndex:
    """Corpus vectors stored by their nearest centre, and the centres.

    ``vectors`` is ``(doc_id, vector, slice, cell)``; ``slices`` says for every
    cell into how many slices its documents are cut.
    """

    vectors: DataFrame
    centers: list[list[float]]
    slices: DataFrame


def build_cells(
    vectors: DataFrame, cells: int | None = None, *, centers: list[list[float]] | None = None,
    training_share: float = 1.0, seed: int = 42, slice_rows: int = 20_000,
) -> CellIndex:
    """Group the corpus vectors around centres and store one folder per cell.

    The centres are given, or ``cells`` of them are learned from the training
    share; every vector of the corpus is stored, in slices of about ``slice_rows``
    documents, so the size of a cell never becomes the size of a task.
    """
    spark = vectors.sparkSession
    usable = vectors.where(F.col("vector").isNotNull()).select("doc_id", "vector")
    if centers is None:
        training = usable if training_share >= 1.0 else usable.sample(training_share, seed)
        features = array_to_vector(F.col("vector").cast("array<double>")).alias("features")
        model = KMeans(k=cells, seed=seed, maxIter=10).fit(training.select(features))
        centers = [c.tolist() for c in model.clusterCenters()]
    homes = usable.withColumn("cell", _nearest_cells(centers, 1)("vector")[0])
    counted = homes.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"))
    known = spark.range(len(centers)).select(F.col("id").cast("int").alias("cell"))
    parts = F.greatest(F.lit(1), F.ceil(F.coalesce("rows", F.lit(0)) / slice_rows)).cast("int")
    slices = store(known.join(counted, "cell", "left").select("cell", parts.alias("slices")), "cell-slices").df
    placed = _sliced(homes, slices).repartition("cell", "slice")
    return CellIndex(store(placed, "cells", partition_by="cell").df, centers, slices)


def _sliced(homes: DataFrame, slices: DataFrame) -> DataFrame:
    """Rows with the slice of their document; there is one row of ``slices`` per centre."""
    number = F.pmod(F.xxhash64("doc_id"), F.col("slices")).cast("int")
    return homes.join(F.broadcast(slices), "cell").select("doc_id", "vector", number.alias("slice"), "cell")


def change_cells(index: CellIndex, changed: DataFrame, vectors: DataFrame) -> CellIndex:
    """Cells after an upsert: ``changed`` ids leave their cells, ``vectors`` enter theirs.

    The centres stay; build the cells again when the corpus no longer resembles them.
    """
    usable = vectors.where(F.col("vector").isNotNull()).select("doc_id", "vector")
    homes = usable.withColumn("cell", _nearest_cells(index.centers, 1)("vector")[0])
    kept = index.vectors.join(changed, "doc_id", "left_anti")
    entered = store(_sliced(homes, index.slices), "cells", partition_by="cell").df
    return CellIndex(kept.unionByName(entered), index.centers, index.slices)


def _nearest_cells(centers: list[list[float]], probes: int):
    """Column function: the ``probes`` cells whose centres are nearest to a vector."""

    def choose(vectors: pa.Array) -> pa.Array:
        import numpy as np

        points = vectors.flatten().to_numpy().astype("float64").reshape(len(vectors), -1)
        known = np.asarray(centers)
        distance = (known * known).sum(axis=1) - 2.0 * (points @ known.T)
        order = np.argsort(distance, axis=1, kind="stable")[:, :probes].astype(np.int32)
        ends = pa.array(np.arange(len(points) + 1, dtype=np.int32) * order.shape[1])
        return pa.ListArray.from_arrays(ends, pa.array(order.ravel()))

    return F.arrow_udf(choose, "array<int>")


def _score_group(k: int, digits: int):
    """Group function: best ``k`` documents of a slice for every query that meets it."""

    def run(queries: pa.Table, documents: pa.Table) -> pa.Table:
        import numpy as np

        ids = np.asarray(documents.column("doc_id").to_pylist(), dtype=str)
        order = np.argsort(ids, kind="stable")
        ids, names = ids[order], np.asarray(queries.column("query_id").to_pylist(), dtype=object)
        owners, found, values = [], [], []
        if len(ids) and len(names):
            asked, held = _matrix(queries), _matrix(documents)[order].T
            step = max(1, _PRODUCTS // len(ids))
            for at in range(0, len(names), step):
                scores = np.round(asked[at : at + step] @ held, digits)
                cut = np.full((len(scores), 1), -np.inf)
                if len(ids) > k:
                    cut = np.partition(scores, len(ids) - k, axis=1)[:, [len(ids) - k]]
                row, column = np.nonzero(scores >= cut)  # ties at the cut included
                value = scores[row, column]
                best = np.lexsort((column, -value, row))
                row, column, value = row[best], column[best], value[best]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                owners.append(names[at + row[place < k]])
                found.append(ids[column[place < k]])
                values.append(value[place < k])
        join = np.concatenate if owners else (lambda _: np.empty(0))
        return pa.table({
            "query_id": pa.array(list(join(owners)), pa.string()), "doc_id": pa.array(list(join(found)), pa.string()),
            "score": pa.array(join(values), pa.float64()),
        })

    return run


def _upto(number: Column) -> Column:
    """One row for each of the numbers from 0."""
    return F.explode(F.sequence(F.lit(0), number - 1).cast("array<int>"))


def _scored(left: DataFrame, right: DataFrame, group: list[str], depth: int, cfg: RetrievalConfig) -> DataFrame:
    """Best documents for every query in each group of queries and documents."""
    return left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(
        _score_group(depth, cfg.score_digits), _SCORED)


def knn_approx(
    queries: DataFrame, index: CellIndex, cfg: RetrievalConfig, *, probes: int,
    depth: int = MAX_DEPTH,
) -> DataFrame:
    """Approximate neighbours: each query looks only at the ``probes`` cells nearest to it.

    Other cells are not read. Found documents carry their exact score, so only
    completeness is approximate; with ``probes`` equal to the number of cells the
    result is exact. Queries travel to the slices of their cells; the queries of a
    cell are cut into parts of about ``query_block_rows``.
    """
    wanted = queries.where(F.col("vector").isNotNull())
    cells = F.explode(_nearest_cells(index.centers, probes)("vector")).alias("cell")
    asked = store(wanted.select("query_id", "vector", cells), "query-cells").df
    # At most one row per centre.
    parts = store(asked.groupBy("cell").agg(
        F.ceil(F.count(F.lit(1)) / cfg.query_block_rows).cast("int").alias("parts")), "cell-parts").df
    probed = [r["cell"] for r in parts.collect()]

    group = ["cell", "slice", "part"]
    left = (
        asked.join(F.broadcast(index.slices), "cell").join(F.broadcast(parts), "cell")
        .withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int"))
        .select("query_id", "vector", "cell", "part", _upto(F.col("slices")).alias("slice"))
    )
    right = (
        index.vectors.where(F.col("cell").isin(probed)).join(F.broadcast(parts), "cell")
        .select("doc_id", "vector", "cell", "slice", _upto(F.col("parts")).alias("part"))
    )
    return _best(_scored(left, right, group, depth, cfg), depth)
