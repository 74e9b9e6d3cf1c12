"""Hybrid search for a table of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrank.config import (
    DEFAULT_LIMIT, DEFAULT_THRESHOLD, DEPTH_FACTOR, EMBEDDING_TTL_SECONDS, MIN_DEPTH, MIN_LIMIT, RESULTS_TTL_SECONDS,
    RetrievalConfig,
)
from quillrank.functions.embedders import QUERY, Scorer
from quillrank.functions.keys import embedding_key, results_key
from quillrank.operators import memo
from quillrank.operators.corpus import documents_named
from quillrank.operators.dense import knn_approx, knn_exact
from quillrank.operators.fuse import cut, rerank_head, rrf_fuse, within_depth
from quillrank.operators.lexical import bm25_top
from quillrank.plans.indexing import SearchIndex
from quillrank.schema import RESULT_ITEMS
from quillrank.sources.tables import in_bounds, with_query_defaults
from quillrank.sources.workspace import Stored, store


LONGEST_TTL_SECONDS = max(EMBEDDING_TTL_SECONDS, RESULTS_TTL_SECONDS)


def validate(
    requests: DataFrame, cfg: RetrievalConfig = RetrievalConfig()
) -> tuple[DataFrame, DataFrame]:
    """Requests with defaults filled in, split into accepted and rejected ones."""
    complete = with_query_defaults(requests, limit=DEFAULT_LIMIT, threshold=DEFAULT_THRESHOLD)
    ok = in_bounds(MIN_LIMIT, cfg.max_limit)
    return complete.where(ok), complete.where(~ok)


def embed_queries(queries: DataFrame, index: SearchIndex) -> DataFrame:
    """``(query_id, vector)``; a text that is asked several times is embedded once."""
    texts = queries.select("q").distinct()
    vectors = texts.withColumn("vector", index.embedder.column(F.col("q"), QUERY))
    return queries.select("query_id", "q").join(vectors, "q").select("query_id", "vector")


def _with_attributes(
    ranked: DataFrame, corpus: DataFrame, columns: list[str], cfg: RetrievalConfig
) -> DataFrame:
    """Look up document columns for stored ranked rows by the ids that occur in them."""
    ids = store(ranked.select("doc_id").distinct(), "page-ids", totals={"chars": F.sum(F.length("doc_id"))})
    found = documents_named(corpus.select("doc_id", *columns), ids, cfg)
    return ranked.join(found, "doc_id", "left")


def nearest_documents(
    vectors: DataFrame, index: SearchIndex, cfg: RetrievalConfig, depth: int
) -> DataFrame:
    """Neighbours of embedded queries, from the probed cells if the settings ask for them."""
    if cfg.probes is None:
        return knn_exact(vectors, index.vectors, cfg, depth)
    if index.cells is None:
        raise ValueError("the index has no cells; add them by with_cells or leave probes unset")
    return knn_approx(vectors, index.cells, cfg, probes=cfg.probes, depth=depth)


def hybrid_ranking(
    queries: Stored, index: SearchIndex, cfg: RetrievalConfig, scorer: Scorer | None = None,
    vectors: DataFrame | None = None,
) -> DataFrame:
    """Fused (and reranked) rows of every accepted query before the final cut.

    ``vectors`` is ``(query_id, vector)`` where the queries are embedded already.
    """
    if vectors is None:
        vectors = embed_queries(queries.df, index)
    # No query looks deeper than the one with the largest limit.
    depth = min(cfg.max_depth, max(MIN_DEPTH, DEPTH_FACTOR * (queries.totals.get("most") or 0)))
    lexical = within_depth(bm25_top(queries.df, index.lexical, cfg, depth), queries.df)
    dense = within_depth(nearest_documents(vectors, index, cfg, depth), queries.df)
    ranked = rrf_fuse(lexical, dense, cfg.rrf_k)
    if scorer is None:
        return ranked
    # Only the head is scored, so only the head needs its text.
    head = store(ranked, "fused")
    top = head.df.where(F.col("rank") <= cfg.rerank_top_k)
    texts = _with_attributes(
        top, index.corpus, ["title", "synopsis"], cfg
    ).join(queries.df.select("query_id", "q"), "query_id")
    scores = texts.select(
        "query_id", "doc_id",
        scorer.column(F.col("q"), F.coalesce("title", F.lit("")), F.coalesce("synopsis", F.lit("")))
        .alias("_model_score"),
    )
    joined = head.df.join(scores, ["query_id", "doc_id"], "left")
    return rerank_head(joined, F.col("_model_score"), cfg.rerank_top_k).drop("_model_score")


def hybrid_search(
    requests: DataFrame, index: SearchIndex, cfg: RetrievalConfig, scorer: Scorer | None = None,
    vectors: DataFrame | None = None,
) -> DataFrame:
    """``(query_id, rank, id, title, bookPicture, score)`` for accepted requests.

    ``requests`` is ``(query_id, q, limit, threshold)``; limit and threshold may
    be NULL. Rejected requests yield no rows; ``validate`` tells them apart.
    """
    accepted, _ = validate(requests, cfg)
    queries = store(accepted, "queries", totals={"most": F.max("limit")})
    page = store(cut(hybrid_ranking(queries, index, cfg, scorer, vectors), queries.df, cfg.max_limit), "page")
    shown = _with_attributes(page.df, index.corpus, ["title", "book_picture"], cfg)
    return shown.select(
        "query_id", "rank", F.col("doc_id").alias("id"),
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("book_picture", F.lit("")).alias("bookPicture"),
        F.round("score", cfg.score_digits).alias("score"),
    )


def memoised_search(
    requests: DataFrame, index: SearchIndex, cfg: RetrievalConfig, cache: DataFrame,
    cache_path: str, now: Column, scorer: Scorer | None = None,
) -> DataFrame:
    """Search that answers from the cache where it can and adds what it computed.

    Query texts that were embedded before are not embedded again.
    Returns ``(query_id, items, source)``. Equal requests are computed once; a
    request without results is remembered as such.
    """
    accepted, _ = validate(requests, cfg)
    namespace = f"{index.embedder.name}|{scorer.name if scorer else 'none'}"
    if cfg.probes is not None:  # other results than those of the exact search
        namespace += f"|{cfg.probes}"
    keyed = store(accepted.withColumn(
        "key", results_key(F.col("q"), F.col("limit"), F.col("threshold"), namespace)
    ), "keyed-queries").df
    # Both sides are settled before this search writes to the cache.
    known = store(memo.lookup(keyed, cache, now, LONGEST_TTL_SECONDS).select(
        "query_id", "key", F.from_json("payload", RESULT_ITEMS).alias("items"),
        F.lit("cache").alias("source"),
    ), "cache-hits").df
    missing = store(memo.misses(keyed, cache, now, LONGEST_TTL_SECONDS), "cache-misses").df
    unique = missing.dropDuplicates(["key"]).select(F.col("key").alias("query_id"), "q", "limit", "threshold")
    embedded = store(memo.memo_embeddings(
        unique.select(F.col("q").alias("text")), cache, index.embedder, now, index.embedder.name, LONGEST_TTL_SECONDS
    ), "query-embeddings").df
    vectors = unique.join(embedded, unique["q"] == embedded["text"]).select("query_id", "vector")
    rows = hybrid_search(unique, index, cfg, scorer, vectors)
    item = F.struct("rank", F.struct("id", "title", "bookPicture", "score").alias("item"))
    lists = rows.groupBy("query_id").agg(F.sort_array(F.collect_list(item)).alias("ranked"))
    computed = store(
        unique.select("query_id").join(lists, "query_id", "left").select(
            F.col("query_id").alias("key"),
            F.coalesce(F.transform("ranked", lambda r: r["item"]), F.array().cast(RESULT_ITEMS)).alias("items"),
        ), "computed-results").df
    fresh_vectors = embedded.where("source = 'model'")
    memo.append(memo.entries(
        fresh_vectors, embedding_key(F.col("text"), index.embedder.name), F.to_json("vector"), now,
        EMBEDDING_TTL_SECONDS), cache_path)
    memo.append(
        memo.entries(computed, F.col("key"), F.to_json("items"), now, RESULTS_TTL_SECONDS), cache_path
    )
    fresh = missing.join(computed, "key").select("query_id", "key", "items", F.lit("search").alias("source"))
    return known.unionByName(fresh).select("query_id", "items", "source")
