"""Merging ranked lists, reranking the head, and the final cut."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillrank.config import DEPTH_FACTOR, MIN_DEPTH, RERANK_TOP_K, RRF_K


def candidate_depth(limit: Column) -> Column:
    """How many candidates each retriever delivers for a result of ``limit`` rows."""
    return F.greatest(limit * DEPTH_FACTOR, F.lit(MIN_DEPTH)).cast("int")


def within_depth(ranked: DataFrame, queries: DataFrame) -> DataFrame:
    """Cut every ranked list to the candidate depth of its own query."""
    depths = queries.select("query_id", candidate_depth(F.col("limit")).alias("_depth"))
    return ranked.join(depths, "query_id").where(F.col("rank") <= F.col("_depth")).drop("_depth")


def rrf_fuse(
    lexical: DataFrame, dense: DataFrame, rrf_k: int = RRF_K, depth: int | None = None
) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists per query.

    Equal sums keep the lexical list first, in its order, then the dense one.
    Returns ``(query_id, rank, doc_id, score, bm25_rank, knn_rank)``.
    """
    both = lexical.select(
        "query_id", "doc_id", F.col("rank").alias("bm25_rank"), F.lit(None).cast("int").alias("knn_rank")
    ).unionByName(dense.select(
        "query_id", "doc_id", F.lit(None).cast("int").alias("bm25_rank"), F.col("rank").alias("knn_rank")
    ))
    place = F.coalesce("bm25_rank", "knn_rank")
    fused = both.groupBy("query_id", "doc_id").agg(
        F.sum(1.0 / (rrf_k + place)).alias("score"),
        F.min("bm25_rank").alias("bm25_rank"),
        F.min("knn_rank").alias("knn_rank"),
    )
    best_first = Window.partitionBy("query_id").orderBy(
        F.desc("score"), F.asc_nulls_last("bm25_rank"), F.asc_nulls_last("knn_rank")
    )
    ranked = fused.withColumn("rank", F.row_number().over(best_first))
    if depth is not None:
        ranked = ranked.where(F.col("rank") <= depth)
    return ranked.select("query_id", "rank", "doc_id", "score", "bm25_rank", "knn_rank")


def first_hits(lexical: DataFrame, dense: DataFrame, attributes: list[str]) -> DataFrame:
    """One row per query and document with the attributes of its first hit.

    The lexical copy of a document found by both retrievers comes first.
    """
    hit = F.struct(*attributes)
    both = lexical.select("query_id", "doc_id", F.lit(0).alias("_source"), hit.alias("_hit")).unionByName(
        dense.select("query_id", "doc_id", F.lit(1).alias("_source"), hit.alias("_hit"))
    )
    first = both.groupBy("query_id", "doc_id").agg(
        F.min_by("_hit", "_source").alias("_hit"), F.min("_source").alias("source")
    )
    return first.select("query_id", "doc_id", "_hit.*", F.when(F.col("source") == 0, "bm25")
                        .otherwise("knn").alias("source"))


def rerank_head(ranked: DataFrame, rerank_score: Column, top_k: int = RERANK_TOP_K) -> DataFrame:
    """Reorder the first ``top_k`` rows of every query by ``rerank_score``.

    Head rows carry their rerank score, the tail follows unchanged with its
    fused score, and ``rrf_score`` keeps the fused score of all rows. If the
    scorer failed for any head row of a query, that query keeps its fused order.
    The score is only computed for head rows.
    """
    query = Window.partitionBy("query_id")
    in_head = F.col("rank") <= top_k
    scored = ranked.withColumn("_rerank", F.when(in_head, rerank_score)).withColumn(
        "_failed", F.max(in_head & F.col("_rerank").isNull()).over(query)
    )
    moved = in_head & ~F.col("_failed")
    order = query.orderBy(
        F.asc(F.col("rank") > top_k),
        F.desc_nulls_last(F.when(moved, F.col("_rerank"))),
        F.asc("rank"),
    )
    return (
        scored.withColumn("_place", F.row_number().over(order))
        .withColumn("rrf_score", F.col("score"))
        .withColumn("score", F.when(moved, F.col("_rerank")).otherwise(F.col("score")))
        .withColumn("rank", F.col("_place"))
        .drop("_rerank", "_failed", "_place")
    )


def cut(ranked: DataFrame, queries: DataFrame, max_limit: int | None = None) -> DataFrame:
    """Page limit first, then the score threshold on what is left.

    Rows below the threshold are not replaced by later ones, and a threshold of
    zero keeps everything. A caller that has refused larger limits can name its
    ``max_limit``; a literal bound lets Spark prune early.
    """
    wanted = queries.select("query_id", "limit", "threshold")
    if max_limit is not None:
        ranked = ranked.where(F.col("rank") <= max_limit)
    page = ranked.join(wanted, "query_id")
    return page.where(
        (F.col("rank") <= F.col("limit"))
        & ((F.col("threshold") <= 0) | (F.col("score") >= F.col("threshold")))
    ).drop("limit", "threshold")
