"""Every operator as a query over the given tables: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank import (
    HashingEmbedder, OverlapScorer, apply_changes, bulk_index, hybrid_search, memoised_search, validate,
    with_cells,
)
from quillrank.config import (
    DEFAULT_LIMIT, DEFAULT_THRESHOLD, EMBEDDING_TTL_SECONDS, EVAL_QUERY_COUNT, MAX_LIMIT, MIN_DEPTH,
    MIN_LIMIT, RERANK_TOP_K, RESULTS_TTL_SECONDS, STYLE_LABELS,
)
from quillrank.functions.embedders import QUERY
from quillrank.functions.keys import embedding_key, results_key
from quillrank.functions.text import (
    build_text, synopsis_authors, synopsis_subjects, synopsis_year, tokenize,
)
from quillrank.functions.vectors import dot, l2_norm, l2_normalize
from quillrank.operators import evaluate, fuse, lexical, memo
from quillrank.operators.corpus import assemble, assemble_fanout, embed, latest, spread, write_corpus
from quillrank.operators.dense import build_cells, knn_approx, knn_exact, knn_lsh
from quillrank.operators.fuzzy import expand_terms
from quillrank.plans.evaluation import judge_runs, ranked_runs
from quillrank.plans.stored_index import open_index, save_index
from quillrank.schema import RESULT_ITEMS
from quillrank.sources.tables import (
    create_corpus_if_absent, in_bounds, read_corpus, read_query_set, scan_corpus, with_query_defaults, write_query_set,
)
from quillrank.sources.workspace import bucket_count, new_folder, store
from quillrank.streaming import event_log
from quillrank.streaming import events as ev
from quillrank.streaming import ingest
from workloads import bindings as b

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def query_named(name: str) -> Callable[[Query], Query]:
    """For queries that are called like the library function they use."""

    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return register


def _joined(name: str) -> Column:
    return F.array_join(F.col(name), "|").alias(name)


def _checksum(vector: str = "vector") -> Column:
    """One number that depends on every component of a vector and its place."""
    weighted = F.transform(F.col(vector).cast("array<double>"), lambda x, i: x * (i + 1))
    return F.round(F.aggregate(weighted, F.lit(0.0), lambda a, x: a + x), 6).alias("vec_sum")


def _digits(column: str, places: int = 6) -> Column:
    return F.round(column, places).alias(column)


# --- documents ----------------------------------------------------------------


@query
def assemble_documents(spark, sf):
    return assemble(**b.relations(spark, sf)).select(
        "book_id", "title", "synopsis", "publisher",
        F.array_join(F.coalesce("authors", F.array().cast("array<string>")), "|").alias("authors"),
        F.array_join(F.coalesce("genres", F.array().cast("array<string>")), "|").alias("genres"),
    )


@query_named("assemble_fanout")
def assemble_fanout_documents(spark, sf):
    return assemble_fanout(**b.relations(spark, sf)).select(
        "book_id", "title", "synopsis", "publisher", _joined("authors"), _joined("genres")
    )


@query
def normalize_documents(spark, sf):
    return b.documents(spark, sf).select(
        "doc_id", "title", "synopsis", _joined("authors"), F.size("authors").alias("n_authors"),
        _joined("genres"), "publisher", "book_picture",
    )


@query_named("build_text")
def build_embedding_text(spark, sf):
    docs = b.documents(spark, sf)
    return docs.select("doc_id", build_text(F.col("title"), F.col("synopsis")).alias("text"))


@query
def corpus_scan(spark, sf):
    return scan_corpus(b.documents(spark, sf))


@query
def corpus_page(spark, sf):
    return scan_corpus(b.order_documents(spark, sf), limit=2000)


@query
def corpus_created(spark, sf):
    """A corpus that is created where there is none, filled, and left as it is when it is created again."""
    path = new_folder(spark, "corpus")
    create_corpus_if_absent(spark, path)
    b.document_index(spark, sf).corpus.write.mode("append").parquet(path)
    create_corpus_if_absent(spark, path)
    return scan_corpus(read_corpus(spark, path))


@query
def corpus_half(spark, sf):
    """The first half of all documents by id, a page too long for one task."""
    books = b.order_documents(spark, sf)
    return scan_corpus(books, limit=books.count() // 2)


@query
def corpus_count(spark, sf):
    return b.documents(spark, sf).agg(F.count(F.lit(1)).alias("n_documents"))


@query
def embed_documents(spark, sf):
    placed = spread(b.documents(spark, sf), bucket_count(spark))
    vectors = embed(placed, HashingEmbedder()).select("doc_id", "vector")
    cells = vectors.select("doc_id", F.posexplode_outer("vector").alias("pos", "x"))
    return cells.where(F.col("x") != 0).select(
        "doc_id", "pos", F.round(F.col("x").cast("double"), 6).alias("x")
    )


@query
def embed_queries(spark, sf):
    vector = HashingEmbedder().column(F.col("q"), QUERY)
    return b.free_queries(spark, sf).select("query_id", vector.alias("vector")).select(
        "query_id", F.size("vector").alias("dim"), _checksum()
    )


@query_named("bulk_index")
def bulk_index_documents(spark, sf):
    return b.order_index(spark, sf).corpus.select(
        "doc_id", "title", "synopsis", _joined("authors"), _joined("genres"), "publisher",
        "book_picture", F.size("vector").alias("dim"), _checksum(),
    )


@query
def bulk_index_repeated_ids(spark, sf):
    """Every document twice, the second time with another title: the last one is stored and counted."""
    documents = b.documents(spark, sf).withColumn("version", F.lit(1))
    again = documents.withColumn("title", F.concat(F.lit("New "), F.col("title"))).withColumn("version", F.lit(2))
    index = bulk_index(again.unionByName(documents), HashingEmbedder(), b.config(), ["version"])
    n = index.lexical.field_stats.where("field = 'title'").select("n_docs")
    return index.corpus.select("doc_id", "title").crossJoin(F.broadcast(n))


@query
def bulk_index_counts(spark, sf):
    """Events as documents: those without title or id cannot be embedded and fail."""
    decoded = ev.decode(b.envelopes(b.event_table(spark, sf)))
    vectors = decoded.withColumn("vector", F.when(
        F.col("reason").isNull(),
        HashingEmbedder().column(build_text(F.col("title"), F.col("synopsis"))),
    ))
    nothing = F.array().cast("array<string>")
    shaped = vectors.select(
        F.col("event_id").cast("string").alias("doc_id"), "title", "synopsis",
        nothing.alias("authors"), nothing.alias("genres"), F.lit("").alias("publisher"),
        "book_picture", "vector",
    )
    counts = write_corpus(shaped, new_folder(spark, "counted"), HashingEmbedder().dim)
    total = b.event_table(spark, sf).agg(F.count(F.lit(1)).alias("total"))
    return total.select(
        F.lit(counts["indexed"]).cast("bigint").alias("indexed"),
        F.lit(counts["failed"]).cast("bigint").alias("failed"), "total",
    )


@query
def upsert_latest(spark, sf):
    documents = ev.accepted(ev.decode(ev.routed(b.envelopes(b.event_table(spark, sf)), b.ROUTING_KEY)))
    return latest(documents, "doc_id", ["ts", "event_id"]).select(
        "doc_id", "event_id", "title", "synopsis", _joined("authors"), "publisher", "book_picture"
    )


@query
def upsert_patched(spark, sf):
    documents = ev.accepted(ev.decode(ev.routed(b.envelopes(b.event_table(spark, sf)), b.ROUTING_KEY)))
    return latest(documents, "doc_id", ["ts", "event_id"], mode="patch").select(
        "doc_id", "title", "synopsis"
    )


# --- requests -----------------------------------------------------------------


def _event_requests(spark, sf) -> DataFrame:
    """Search requests with parameters inside and outside the allowed ranges."""
    value = F.col("value")
    return b.event_table(spark, sf).select(
        F.col("event_id").cast("string").alias("query_id"),
        F.col("event_type").alias("q"),
        F.when(F.col("user_id") % 10 != 0, F.floor(value)).cast("int").alias("limit"),
        F.when(F.col("user_id") % 10 != 1, F.round(value / 50, 4)).alias("threshold"),
    )


@query
def query_validate(spark, sf):
    complete = with_query_defaults(
        _event_requests(spark, sf), limit=DEFAULT_LIMIT, threshold=DEFAULT_THRESHOLD)
    return complete.withColumn("ok", in_bounds(MIN_LIMIT, MAX_LIMIT).cast("int"))


@query
def candidate_depth(spark, sf):
    accepted, _ = validate(_event_requests(spark, sf))
    return accepted.select("query_id", "limit", fuse.candidate_depth(F.col("limit")).alias("fetch_k"))


# --- lexical retrieval --------------------------------------------------------


@query_named("tokenize")
def tokenize_documents(spark, sf):
    docs = b.documents(spark, sf).select("doc_id", tokenize(F.col("synopsis")).alias("tokens"))
    return docs.select("doc_id", F.size("tokens").alias("n_tokens"),
                       F.array_join("tokens", " ").alias("tokens"))


@query
def tokenize_unicode(spark, sf):
    """Words of every document between pieces of scripts without spaces, by the Unicode rules."""
    text = F.concat_ws(" ", F.lit("東京タワー と"), "synopsis", F.lit("データ処理 snake_case 3.14 1,000 a:b"))
    docs = b.documents(spark, sf).select("doc_id", tokenize(text, "unicode").alias("tokens"))
    return docs.select("doc_id", F.size("tokens").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens"))


@query
def term_stats(spark, sf):
    return b.document_index(spark, sf).lexical.term_stats


@query
def field_stats(spark, sf):
    return b.document_index(spark, sf).lexical.field_stats.select("field", "n_docs", _digits("avgdl"))


def _plain(**changes):
    return b.RetrievalConfig(fuzzy=False, **changes)


@query
def bm25_single_field(spark, sf):
    cfg = _plain(field_weights={"synopsis": 1.0}, mapping_boosts={})
    return lexical.bm25_top(b.free_queries(spark, sf), b.document_index(spark, sf).lexical, cfg, MIN_DEPTH)


@query
def bm25_multi_field(spark, sf):
    return lexical.bm25_top(
        b.free_queries(spark, sf), b.document_index(spark, sf).lexical, _plain(), MIN_DEPTH)


@query
def bm25_multi_field_fuzzy(spark, sf):
    return lexical.bm25_top(
        b.free_queries(spark, sf), b.document_index(spark, sf).lexical, b.config(), MIN_DEPTH)


@query
def fuzzy_expand(spark, sf):
    cfg = b.config()
    wanted = store(
        lexical.query_terms(b.free_queries(spark, sf), cfg).select("kind", "q_term").distinct(), "wanted")
    index = b.document_index(spark, sf).lexical
    stats = index.term_stats
    kind = F.when(F.col("field") == "genres", lexical.KEYWORD).otherwise(lexical.TEXT)
    expanded = expand_terms(wanted.df, stats.withColumn("kind", kind), index.keys, cfg, wanted.rows)
    return expanded.select("field", "q_term", "term", F.col("edits").cast("int").alias("edits"),
                           _digits("boost"), "df")


def _changed_index(spark, sf):
    """The documents after an upsert: German texts are replaced, users become documents."""
    docs = b.documents(spark, sf)
    german = docs.where(F.array_contains("genres", "de")).withColumn(
        "synopsis", F.concat_ws(" ", "title", "publisher"))
    users = latest(ev.accepted(ev.decode(ev.routed(
        b.envelopes(b.event_table(spark, sf)), b.ROUTING_KEY))), "doc_id", ["ts", "event_id"])
    new = users.withColumn("doc_id", F.concat(F.lit("u"), F.col("doc_id"))).select(docs.columns)
    return apply_changes(b.document_index(spark, sf), german.unionByName(new), b.config())


@query
def index_update_stats(spark, sf):
    return _changed_index(spark, sf).lexical.field_stats.select("field", "n_docs", _digits("avgdl"))


@query
def index_update_terms(spark, sf):
    return _changed_index(spark, sf).lexical.term_stats


@query
def index_update_search(spark, sf):
    index = _changed_index(spark, sf)
    return lexical.bm25_top(b.free_queries(spark, sf), index.lexical, _plain(), MIN_DEPTH)


# --- dense retrieval ----------------------------------------------------------


@query_named("l2_normalize")
def l2_normalize_vectors(spark, sf):
    scaled = b.vectors(spark, sf).select(
        "doc_id", F.transform("vector", lambda x: x.cast("double") * F.col("label")).alias("vector"))
    unit = scaled.select("doc_id", F.round(l2_norm(F.col("vector")), 6).alias("norm"),
                         F.posexplode(l2_normalize(F.col("vector"))).alias("pos", "x"))
    return unit.select("doc_id", "norm", "pos", _digits("x"))


@query
def cosine_scores(spark, sf):
    centres = b.label_centres(spark, sf).select("label", l2_normalize(F.col("vector")).alias("centre"))
    return b.vectors(spark, sf).join(centres, "label").select(
        "doc_id", "label", F.round(dot(F.col("vector"), F.col("centre")), 6).alias("score"))


def _centre_queries(spark, sf) -> DataFrame:
    return b.label_centres(spark, sf).select(
        F.col("label").cast("string").alias("query_id"), l2_normalize(F.col("vector")).alias("vector"))


@query_named("knn_exact")
def knn_exact_vectors(spark, sf):
    return knn_exact(_centre_queries(spark, sf), b.vectors(spark, sf), b.config(), MIN_DEPTH)


@query
def knn_exact_documents(spark, sf):
    queries = b.free_queries(spark, sf).select(
        "query_id", HashingEmbedder().column(F.col("q"), QUERY).alias("vector"))
    return knn_exact(queries, b.document_index(spark, sf).vectors, b.config(), MIN_DEPTH)


@query_named("knn_approx")
def knn_approx_vectors(spark, sf):
    cells = build_cells(b.vectors(spark, sf), 16)
    return knn_approx(_centre_queries(spark, sf), cells, b.config(), probes=8, depth=MIN_DEPTH)


@query
def knn_given_cells(spark, sf):
    """Neighbours from the three nearest of the cells around the label centres."""
    centres = _centre_queries(spark, sf).orderBy(F.col("query_id").cast("int")).collect()
    cells = build_cells(b.vectors(spark, sf), centers=[list(r["vector"]) for r in centres])
    return knn_approx(_centre_queries(spark, sf), cells, b.config(), probes=3, depth=MIN_DEPTH)


@query
def knn_cells_recall(spark, sf):
    """Part of the exact neighbours of every query that three given cells find."""
    exact, found = knn_exact_vectors(spark, sf), knn_given_cells(spark, sf)
    hits = exact.join(found.select("query_id", "doc_id", F.lit(1).alias("hit")), ["query_id", "doc_id"], "left")
    return hits.groupBy("query_id").agg(
        F.round(F.count("hit") / F.count(F.lit(1)), 6).alias("recall"))


@query_named("knn_lsh")
def knn_lsh_vectors(spark, sf):
    """Neighbours by hashing with buckets so wide that none is missed."""
    return knn_lsh(_centre_queries(spark, sf), b.vectors(spark, sf), b.config(), MIN_DEPTH, bucket_length=1.0)


@query
def knn_lsh_recall(spark, sf):
    """Whether hashing with short buckets finds nine of ten exact neighbours of all queries together."""
    queries, vectors = _centre_queries(spark, sf), b.vectors(spark, sf)
    exact = knn_exact(queries, vectors, b.config(), MIN_DEPTH)
    found = knn_lsh(queries, vectors, b.config(), MIN_DEPTH, bucket_length=0.15, tables=12)
    hits = exact.join(found.select("query_id", "doc_id", F.lit(1).alias("hit")), ["query_id", "doc_id"], "left")
    return hits.agg(F.count(F.lit(1)).alias("neighbours"),
                    (F.count("hit") >= 0.9 * F.count(F.lit(1))).cast("int").alias("enough"))


@query
def knn_all_cells_vectors(spark, sf):
    cells = build_cells(b.vectors(spark, sf), 16)
    return knn_approx(_centre_queries(spark, sf), cells, b.config(), probes=16, depth=MIN_DEPTH)


# --- fusion -------------------------------------------------------------------


@query
def rrf_fuse(spark, sf):
    first, second = b.order_lists(spark, sf, mirrored=False)
    return fuse.rrf_fuse(first, second).withColumn("score", F.round("score", 9))


@query
def rrf_ties(spark, sf):
    first, second = b.order_lists(spark, sf, mirrored=True)
    return fuse.rrf_fuse(first, second).withColumn("score", F.round("score", 9))


@query
def hit_dedup_first(spark, sf):
    first, second = b.order_lists(spark, sf, mirrored=False)
    first = first.withColumn("title", F.concat(F.lit("A "), F.col("title")))
    second = second.where(F.col("rank") <= MIN_DEPTH)
    return fuse.first_hits(first.where(F.col("rank") <= 5), second, ["title"])


@query
def threshold_after_limit(spark, sf):
    first, second = b.order_lists(spark, sf, mirrored=False)
    fused = fuse.rrf_fuse(first, second)
    key = F.col("o_custkey")
    wanted = b.table(spark, sf, "orders").select("o_custkey").distinct().select(
        key.cast("string").alias("query_id"), (key % 12 + 1).cast("int").alias("limit"),
        F.when(key % 3 == 0, 0.0).otherwise(0.031).alias("threshold"))
    return fuse.cut(fused, wanted).select("query_id", "rank", "doc_id", F.round("score", 9).alias("score"))


@query
def rerank_head_tail(spark, sf):
    index = b.document_index(spark, sf)
    cfg = _plain(field_weights={"synopsis": 1.0}, mapping_boosts={})
    queries = b.free_queries(spark, sf)
    ranked = lexical.bm25_top(queries, index.lexical, cfg, MAX_LIMIT)
    # Only the head is scored, so only the head needs its text.
    held = store(ranked, "ranked").df
    head = held.where(F.col("rank") <= RERANK_TOP_K).select("query_id", "doc_id")
    texts = head.join(index.corpus.select("doc_id", "title", "synopsis"), "doc_id").join(queries, "query_id")
    score = OverlapScorer().column(F.col("q"), F.col("title"), F.col("synopsis")).alias("_model_score")
    joined = held.join(texts.select("query_id", "doc_id", score), ["query_id", "doc_id"], "left")
    return fuse.rerank_head(joined, F.col("_model_score")).select("query_id", "rank", "doc_id", "score", "rrf_score")


@query_named("hybrid_search")
def hybrid_search_documents(spark, sf):
    return hybrid_search(b.requests(spark, sf), b.document_index(spark, sf), b.config())


@query
def hybrid_search_cells(spark, sf):
    """Hybrid search through the approximate neighbours, with all cells probed."""
    index = with_cells(b.document_index(spark, sf), 8, slice_rows=500)
    return hybrid_search(b.requests(spark, sf), index, replace(b.config(), probes=8))


@query
def reopened_search(spark, sf):
    """Hybrid search in an index that was saved and is opened by its path alone."""
    path = new_folder(spark, "saved-index")
    save_index(b.document_index(spark, sf), path, b.config())
    index, cfg = open_index(spark, path, HashingEmbedder())
    return hybrid_search(b.requests(spark, sf), index, cfg)


@query_named("memoised_search")
def memoised_search_twice(spark, sf):
    """All requests after every second one was answered before: what comes from the cache, and how much."""
    path, now = new_folder(spark, "memo"), _now(spark, sf)
    index, asked = b.document_index(spark, sf), b.requests(spark, sf)
    nothing = memo.entries(asked.limit(0), F.col("q"), F.col("q"), now, 1)
    memo.append(nothing, path)
    cache = lambda: spark.read.schema(nothing.schema).parquet(path)
    first = asked.where(F.col("query_id").cast("long") % 2 == 0)
    memoised_search(first, index, b.config(), cache(), path, now).count()
    found = memoised_search(asked, index, b.config(), cache(), path, now)
    return found.select("query_id", "source", F.size("items").cast("long").alias("n_items"))


@query
def hybrid_search_reranked(spark, sf):
    return hybrid_search(b.requests(spark, sf), b.document_index(spark, sf), b.config(), OverlapScorer())


# --- memo ---------------------------------------------------------------------


def _now(spark, sf) -> Column:
    """The clock of the cache queries: a fixed time inside the period of the events."""
    return F.lit("2024-01-15 12:00:00").cast("timestamp")


def _cache_log(spark, sf) -> DataFrame:
    """What earlier requests, one per event, would have written."""
    rows = b.event_table(spark, sf).withColumn("q", F.concat_ws(" ", "event_type", "user_id"))
    key = results_key(F.col("q"), F.lit(DEFAULT_LIMIT), F.lit(DEFAULT_THRESHOLD))
    item = F.struct(
        F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("title"),
        F.lit("").alias("bookPicture"), F.col("value").alias("score"))
    payload = F.to_json(F.when(F.col("value") < 5, F.array().cast(RESULT_ITEMS)).otherwise(F.array(item)))
    return memo.entries(rows, key, payload, F.col("ts").cast("timestamp"), 12 * RESULTS_TTL_SECONDS)


def _cache_requests(spark, sf) -> DataFrame:
    pairs = b.event_table(spark, sf).select("event_type", "user_id").distinct()
    keyed = pairs.withColumn("q", F.concat_ws(" ", "event_type", "user_id"))
    return keyed.select("q", results_key(
        F.col("q"), F.lit(DEFAULT_LIMIT), F.lit(DEFAULT_THRESHOLD)).alias("key"))


@query
def cache_keys(spark, sf):
    complete = with_query_defaults(
        b.requests(spark, sf), limit=DEFAULT_LIMIT, threshold=DEFAULT_THRESHOLD)
    return complete.select(
        "query_id", embedding_key(F.col("q")).alias("emb_key"),
        results_key(F.col("q"), F.col("limit"), F.col("threshold")).alias("res_key"))


@query
def cache_put_latest(spark, sf):
    return memo.newest(_cache_log(spark, sf)).select(
        "key", F.get_json_object("payload", "$[0].id").alias("first_id"),
        b.micros(F.col("written_at")).alias("written_at"), b.micros(F.col("expires_at")).alias("expires_at"))


@query
def cache_lookup(spark, sf):
    found = memo.lookup(_cache_requests(spark, sf), _cache_log(spark, sf), _now(spark, sf))
    items = F.from_json("payload", RESULT_ITEMS)
    return found.select("q", F.size(items).alias("n_items"), b.micros(F.col("expires_at")).alias("expires_at"))


@query
def cache_recent(spark, sf):
    """The same lookup in a stored cache: no entry lives longer than an hour, older folders are not read."""
    path = new_folder(spark, "memo-log")
    memo.append(_cache_log(spark, sf), path)
    found = memo.lookup(_cache_requests(spark, sf), spark.read.parquet(path), _now(spark, sf), 12 * RESULTS_TTL_SECONDS)
    items = F.from_json("payload", RESULT_ITEMS)
    return found.select("q", F.size(items).alias("n_items"), b.micros(F.col("expires_at")).alias("expires_at"))


@query
def cache_hits(spark, sf):
    return memo.hits(_cache_requests(spark, sf), _cache_log(spark, sf), _now(spark, sf))


@query
def cache_long_ttl(spark, sf):
    """Entries that live from a minute to a day, next to each other under the same keys."""
    rows = b.event_table(spark, sf).withColumn("q", F.concat_ws(" ", "event_type", "user_id"))
    key = results_key(F.col("q"), F.lit(DEFAULT_LIMIT), F.lit(DEFAULT_THRESHOLD))
    life = F.element_at(F.array(F.lit(60), F.lit(7200), F.lit(86400)), (F.col("event_id") % 3 + 1).cast("int"))
    cache = memo.entries(rows, key, F.lit("[]"), F.col("ts").cast("timestamp"), life)
    found = memo.lookup(_cache_requests(spark, sf), cache, _now(spark, sf))
    return found.select("q", b.micros(F.col("expires_at")).alias("expires_at"))


@query
def cache_misses(spark, sf):
    return memo.misses(_cache_requests(spark, sf), _cache_log(spark, sf), _now(spark, sf))


@query
def cache_roundtrip(spark, sf):
    back = _cache_log(spark, sf).select(F.inline(F.from_json("payload", RESULT_ITEMS)))
    return back.select(F.col("id").cast("bigint").alias("id"), "title", "bookPicture", "score")


@query
def memo_embeddings(spark, sf):
    """Documents as texts; the first half of the sources was embedded before."""
    whole = build_text(F.col("title"), F.col("synopsis"))
    texts = b.documents(spark, sf).select(whole.alias("text"), "publisher")
    model = HashingEmbedder()
    known = texts.where(F.col("publisher") < "src15").select("text").distinct()
    now = _now(spark, sf)
    cache = memo.entries(
        known, embedding_key(F.col("text")), F.to_json(model.column(F.col("text"), QUERY)),
        now - F.make_dt_interval(mins=F.lit(10)), EMBEDDING_TTL_SECONDS)
    out = memo.memo_embeddings(texts, cache, model, now)
    return out.select("text", "source", F.size("vector").alias("dim"), _checksum())


# --- evaluation ---------------------------------------------------------------


@query
def parse_synopsis(spark, sf):
    synopsis = F.col("synopsis")
    return b.relations(spark, sf)["book"].select(
        F.col("id").cast("string").alias("doc_id"),
        F.array_join(synopsis_authors(synopsis), "|").alias("authors"),
        synopsis_year(synopsis).alias("year"),
        F.array_join(synopsis_subjects(synopsis), "|").alias("subjects"))


def _order_books(spark, sf) -> DataFrame:
    book = b.relations(spark, sf)["book"]
    return book.select(F.col("id").cast("string").alias("doc_id"), "title", "synopsis")


@query
def gen_queries_keyword(spark, sf):
    return evaluate.styled_queries(scan_corpus(b.documents(spark, sf)), "keyword", b.SEED)


@query
def gen_queries_author(spark, sf):
    return evaluate.styled_queries(_order_books(spark, sf), "author", b.SEED)


@query
def gen_queries_subject(spark, sf):
    return evaluate.styled_queries(_order_books(spark, sf), "subject", b.SEED)


@query
def gen_queries_year(spark, sf):
    return evaluate.styled_queries(_order_books(spark, sf), "year", b.SEED)


def _mixed(spark, sf) -> DataFrame:
    return evaluate.generate_queries(
        _order_books(spark, sf), EVAL_QUERY_COUNT, list(STYLE_LABELS), b.SEED)


@query
def gen_queries_mixed(spark, sf):
    return _mixed(spark, sf)


@query
def query_set_saved(spark, sf):
    """The mixed queries, saved as JSON lines and loaded again."""
    path = new_folder(spark, "query-set")
    write_query_set(_mixed(spark, sf), path)
    return read_query_set(spark, path)


@query
def query_style_counts(spark, sf):
    return evaluate.style_counts(_mixed(spark, sf))


_judgements: dict[tuple[str, str], DataFrame] = {}


def _judged(spark, sf) -> DataFrame:
    """Judged runs of all methods, made when a session first asks for them."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _judgements:
        qrels = store(_mixed(spark, sf), "qrels").df
        runs = ranked_runs(qrels, b.order_index(spark, sf), b.config())
        _judgements[key] = store(judge_runs(qrels, runs), "judged").df
    return _judgements[key]


@query
def eval_hits(spark, sf):
    """Where each relevant document stands, for every method."""
    return _judged(spark, sf).select("method", "query_id", "style", "rank")


def _metric(spark, sf, *names: str) -> DataFrame:
    long = evaluate.metrics_long(_judged(spark, sf))
    return long.where(F.col("metric").isin(*names)).select("method", "metric", _digits("value"))


@query
def eval_mrr(spark, sf):
    return _metric(spark, sf, "MRR@10")


@query
def eval_ndcg(spark, sf):
    return _metric(spark, sf, "NDCG@10")


@query
def eval_metrics(spark, sf):
    return evaluate.metrics_long(_judged(spark, sf)).select("method", "metric", _digits("value"))


@query
def eval_metrics_wide(spark, sf):
    return evaluate.metrics_wide(evaluate.metrics_long(_judged(spark, sf)))


# --- events -------------------------------------------------------------------


@query
def parse_events(spark, sf):
    decoded = ev.decode(ev.routed(b.envelopes(b.event_table(spark, sf)), b.ROUTING_KEY))
    return ev.accepted(decoded).select("event_id", "doc_id", "title", "synopsis", "book_picture")


@query
def rejected_events(spark, sf):
    decoded = ev.decode(ev.routed(b.envelopes(b.event_table(spark, sf)), b.ROUTING_KEY))
    return ev.rejected(decoded).select("event_id", "reason", "body")


def _ingested(spark, sf) -> str:
    path = new_folder(spark, "ingest")
    stream = b.envelopes(b.event_stream(spark, sf))
    ingest.start_ingest(
        stream, HashingEmbedder(), path, routing_key=b.ROUTING_KEY, once=True).awaitTermination()
    return path


def _snapshot(spark, path) -> DataFrame:
    return ingest.snapshot(spark, path).select(
        "doc_id", "title", "synopsis", _joined("authors"), "publisher", "book_picture", _checksum())


@query
def stream_upsert(spark, sf):
    return _snapshot(spark, _ingested(spark, sf))


@query
def stream_restarted(spark, sf):
    """Events that arrive in four files, the latest days first, one file in each micro-batch; the
    ingest is started anew after every two of them and goes on where it stopped."""
    path = new_folder(spark, "restarted")
    events = b.envelopes(b.event_table(spark, sf))
    for parts in ((3, 2), (1, 0)):
        for part in parts:
            events.where(F.dayofyear("ts") % 4 == part).coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = ev.read_event_files(spark, f"{path}/in", max_files=1, fmt="parquet")
        ingest.start_ingest(
            stream, HashingEmbedder(), f"{path}/out", routing_key=b.ROUTING_KEY, once=True).awaitTermination()
    return _snapshot(spark, f"{path}/out")


@query
def stream_event_log(spark, sf):
    """Events in three segments of a log, the latest days first. The ingest stops after a part of them,
    within a segment, and a new one goes on from there in batches of the same size."""
    path = new_folder(spark, "event-log")
    events = b.envelopes(b.event_table(spark, sf))
    for number, part in enumerate((2, 1, 0)):
        event_log.append_segment(events.where(F.dayofyear("ts") % 3 == part), f"{path}/in", number)
    limit = max(events.count() // 5, 1)

    def start(once: bool):
        stream = event_log.read_event_log(
            spark, f"{path}/in", routing_key=b.ROUTING_KEY, max_events=limit, events_per_task=max(limit // 3, 1))
        return ingest.start_ingest(
            stream, HashingEmbedder(), f"{path}/out", routing_key=b.ROUTING_KEY, once=once)

    start(once=True).awaitTermination()
    ingest.finish(start(once=False))
    return _snapshot(spark, f"{path}/out")


@query
def stream_replayed(spark, sf):
    """The same micro-batch delivered twice, as after a failure before its commit."""
    path = new_folder(spark, "replayed")
    decoded = ev.decode(ev.routed(b.envelopes(b.event_table(spark, sf)), b.ROUTING_KEY))
    for _ in range(2):
        ingest.write_batch(decoded, 0, HashingEmbedder(), path)
    return _snapshot(spark, path)


@query
def stream_compacted(spark, sf):
    """The same corpus, read from a snapshot of the log."""
    path = _ingested(spark, sf)
    ingest.compact(spark, path, 0)
    return _snapshot(spark, path)


@query
def stream_latest_by_key(spark, sf):
    path = new_folder(spark, "latest")
    stream = ev.accepted(ev.decode(ev.routed(b.envelopes(b.event_stream(spark, sf)), b.ROUTING_KEY)))
    slim = stream.select("doc_id", "event_id", "ts", "title", "synopsis")
    ingest.start_latest(ev.latest_by_key(slim), path, once=True).awaitTermination()
    rows = "doc_id string, event_id bigint, ts timestamp, title string, synopsis string"
    return ingest.read_latest(spark, path, rows).select("doc_id", "event_id", "title", "synopsis")


@query
def stream_dedup(spark, sf):
    """Every event is delivered twice and let through once."""
    path = new_folder(spark, "dedup")
    once, again = (b.envelopes(b.event_stream(spark, sf)) for _ in range(2))
    unique = ev.without_redelivered(once.unionByName(again))
    (
        unique.writeStream.format("parquet").option("path", f"{path}/events")
        .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
        .start().awaitTermination()
    )
    return spark.read.schema(unique.schema).parquet(f"{path}/events").select(
        "event_id", "routing_key", "body")


@query
def stream_late_events(spark, sf):
    """Events in several micro-batches, the latest days first and each twice: none is lost for its age."""
    path = new_folder(spark, "late")
    events = b.event_table(spark, sf).select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    day = F.dayofyear("ts")
    for part in (3, 2, 1, 0):
        events.where(day % 4 == part).union(events.where(day % 4 == part)).coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    (
        ev.without_redelivered(stream).writeStream.format("parquet").option("path", f"{path}/events")
        .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
        .start().awaitTermination()
    )
    return spark.read.schema(events.schema).parquet(f"{path}/events").select("event_id", "ts")
