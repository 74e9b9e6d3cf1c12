"""Comparison of the retrieval methods on labelled queries."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.config import EVAL_CUTOFFS, RetrievalConfig
from quillrank.operators.evaluate import metrics_long
from quillrank.operators.fuse import rrf_fuse
from quillrank.operators.lexical import bm25_top
from quillrank.plans.indexing import SearchIndex
from quillrank.plans.search import embed_queries, nearest_documents
from quillrank.sources.workspace import store

METHODS = ("BM25", "Dense", "Hybrid-RRF")


def ranked_runs(
    qrels: DataFrame, index: SearchIndex, cfg: RetrievalConfig, cutoffs: Sequence[int] = EVAL_CUTOFFS
) -> DataFrame:
    """``(method, query_id, rank, doc_id)`` of all three methods.

    The lists are cut at the largest cutoff before they are fused.
    """
    depth = max(cutoffs)
    queries = qrels.select("query_id", F.col("query").alias("q"))
    lexical = store(bm25_top(queries, index.lexical, cfg, depth), "bm25-run").df
    dense = store(nearest_documents(embed_queries(queries, index), index, cfg, depth), "dense-run").df
    fused = rrf_fuse(lexical, dense, cfg.rrf_k, depth)
    runs = zip(METHODS, (lexical, dense, fused))
    return reduce(DataFrame.unionByName, [
        run.select(F.lit(name).alias("method"), "query_id", "rank", "doc_id") for name, run in runs
    ])


def judge_runs(qrels: DataFrame, runs: DataFrame) -> DataFrame:
    """Every labelled query once per method, with the rank of its relevant document."""
    per_method = qrels.withColumn("method", F.explode(F.array(*[F.lit(m) for m in METHODS])))
    found = runs.select("method", "query_id", F.col("doc_id").alias("relevant_id"), "rank")
    return per_method.select("method", "query_id", "relevant_id", "style").join(
        found, ["method", "query_id", "relevant_id"], "left"
    )


def evaluate(
    qrels: DataFrame, index: SearchIndex, cfg: RetrievalConfig, cutoffs: Sequence[int] = EVAL_CUTOFFS
) -> DataFrame:
    """``(method, metric, value)`` for BM25, dense and fused retrieval.

    An empty corpus or query set is an error, not a set of zeros.
    """
    if index.corpus.isEmpty():
        raise ValueError("the corpus is empty; index documents first")
    stored = store(qrels, "qrels")
    if not stored.rows:
        raise ValueError("there are no labelled queries to evaluate")
    labelled = stored.df
    return metrics_long(judge_runs(labelled, ranked_runs(labelled, index, cfg, cutoffs)), cutoffs)
