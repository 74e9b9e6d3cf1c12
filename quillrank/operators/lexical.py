"""BM25 over several weighted fields.

The index is a flat table of postings ``(term_part, doc_id, field, term, tf, dl)``.
Stored, it is partitioned by a hash of the term, so a query reads only the folders
of its own terms, and bucketed by document, so that all postings of one
document meet in one task: scores are summed and cut to the best documents of
every task without shuffling postings, and a word that occurs in every document
is spread over all tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from quillrank.config import MAX_DEPTH, RetrievalConfig
from quillrank.functions.text import clean_list, term_frequencies, tokenize, tokenize_list
from quillrank.operators.fuzzy import KEY_PART, expand_terms, keys_of
from quillrank.operators.scoring import best_field, best_scored, scored_parts, stats_of, term_part
from quillrank.operators.topk import top_k
from quillrank.sources.workspace import SMALL_FILES, Stored, bucket_count, store, store_bucketed, without_dictionary

TEXT = "text"
KEYWORD = "keyword"


def _field_tokens(corpus: DataFrame, name: str, cfg: RetrievalConfig) -> Column:
    column = F.col(name)
    is_list = corpus.schema[name].dataType.typeName() == "array"
    if cfg.is_keyword(name):
        values = column if is_list else F.array(column)
        return F.array_distinct(clean_list(values))
    return tokenize_list(column, cfg.analyzer) if is_list else tokenize(column, cfg.analyzer)


def analyze(corpus: DataFrame, cfg: RetrievalConfig) -> DataFrame:
    """``(doc_id, field, dl, terms)``: one row per document and non-empty field."""
    fields = F.array(*[
        F.struct(F.lit(name).alias("field"), _field_tokens(corpus, name, cfg).alias("tokens"))
        for name in cfg.field_weights
    ])
    return (
        corpus.select("doc_id", F.inline(fields))
        .where(F.size("tokens") > 0)
        .select(
            "doc_id", "field",
            F.size("tokens").alias("dl"),
            term_frequencies(F.col("tokens")).alias("terms"),
        )
    )


def postings_of(analyzed: DataFrame, cfg: RetrievalConfig) -> DataFrame:
    # The outer form infers no filter, which would compute the frequencies again.
    return analyzed.select("doc_id", "field", "dl", F.inline_outer("terms")).select(
        "doc_id", "field", "term", "tf", "dl", term_part(cfg, F.col("term")).alias("term_part"),
    )


def term_stats_of(postings: DataFrame) -> DataFrame:
    """Document frequency per field and term, summed up in every task first."""
    return postings.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))


def length_totals(postings: DataFrame) -> DataFrame:
    """``(field, n_docs, total_dl)``: documents that have the field, and all their words."""
    lengths = postings.groupBy("doc_id", "field").agg(F.first("dl").alias("dl"))
    return lengths.groupBy("field").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("dl").alias("total_dl")
    )


def with_average(totals: DataFrame) -> DataFrame:
    """Field statistics with the average length."""
    return totals.withColumn("avgdl", F.col("total_dl") / F.col("n_docs"))


@dataclass(frozen=True)
class LexicalIndex:
    """Postings in one or more parts that share no document, and statistics over all of them.

    ``term_rows`` are the rows whose sums are the term statistics of a changed index.
    """

    parts: tuple[DataFrame, ...]
    term_stats: DataFrame
    field_stats: DataFrame
    keys: DataFrame
    term_rows: DataFrame | None = None

    @property
    def term_log(self) -> DataFrame:
        """Term statistics before they are summed up, for look-ups of few terms."""
        return self.term_stats if self.term_rows is None else self.term_rows


def build_lexical_index(corpus: DataFrame, cfg: RetrievalConfig, buckets: int | None = None) -> LexicalIndex:
    """Analyse the corpus once and store postings, statistics and fuzzy keys.

    ``buckets`` are those of a stored corpus, so that no row moves. Lengths are added up while the documents pass; only the counts per term are
    exchanged.
    """
    spark = corpus.sparkSession
    used = corpus.select("doc_id", *cfg.field_weights)
    seen, names = Observation(), list(cfg.field_weights)
    own = [F.col("field") == name for name in names]
    analyzed = analyze(used, cfg).observe(
        seen, *[F.count_if(is_own).alias(f"n_{i}") for i, is_own in enumerate(own)],
        *[F.coalesce(F.sum(F.when(is_own, F.col("dl"))), F.lit(0)).alias(f"dl_{i}") for i, is_own in enumerate(own)],
    )
    postings = postings_of(analyzed, cfg)
    stored = store_bucketed(
        postings.write.options(**without_dictionary("doc_id")).partitionBy("term_part"), spark, "postings",
        buckets or bucket_count(spark, cfg.index_buckets, corpus),
    )
    term_stats = store(term_stats_of(stored), "term-stats", options=SMALL_FILES).df
    totals = [(name, seen.get[f"n_{i}"], seen.get[f"dl_{i}"]) for i, name in enumerate(names)]
    lengths = spark.createDataFrame([t for t in totals if t[1]], "field string, n_docs long, total_dl long").coalesce(1)
    field_stats = store(with_average(lengths), "field-stats").df
    keys = store(keys_of(term_stats, cfg.key_partitions), "fuzzy-keys", partition_by=KEY_PART,
                 options={**SMALL_FILES, **without_dictionary("_key", "term")}).df
    return LexicalIndex((stored,), term_stats, field_stats, keys)


def query_terms(queries: DataFrame, cfg: RetrievalConfig) -> DataFrame:
    """``(query_id, kind, q_term, qtf)``.

    Text fields see the analysed words of the query, keyword fields see the
    whole query as one term.
    """
    words = queries.select("query_id", F.inline(term_frequencies(tokenize(F.col("q"), cfg.analyzer)))).select(
        "query_id", F.lit(TEXT).alias("kind"), F.col("term").alias("q_term"),
        F.col("tf").alias("qtf"),
    )
    if not any(cfg.is_keyword(name) for name in cfg.field_weights):
        return words
    whole = queries.where(F.col("q") != "").select(
        "query_id", F.lit(KEYWORD).alias("kind"), F.col("q").alias("q_term"),
        F.lit(1).alias("qtf"),
    )
    return words.unionByName(whole)


def _field_kind(cfg: RetrievalConfig) -> Column:
    keyword = [name for name in cfg.field_weights if cfg.is_keyword(name)]
    return F.when(F.col("field").isin(keyword), KEYWORD).otherwise(TEXT)


def _weight_of_field(cfg: RetrievalConfig) -> Column:
    pairs = [part for name in cfg.field_weights for part in (F.lit(name), F.lit(cfg.weight(name)))]
    return F.element_at(F.create_map(*pairs), F.col("field"))


def query_weights(queries: DataFrame, index: LexicalIndex, cfg: RetrievalConfig) -> DataFrame:
    """``(query_id, field, term, weight, df, avgdl, term_part)``.

    The weight is what a term contributes to the score of a document at most. It
    contains the inverse document frequency, the query term frequency, the field
    weight and, for expanded terms, the boost of the expansion. ``df`` is the
    number of documents that have the term in that field, ``avgdl`` the average
    length of the field.
    """
    wanted = store(query_terms(queries, cfg), "query-terms").df
    vocabulary = (
        index.term_log.where(F.col("field").isin(list(cfg.field_weights)))
        .withColumn("kind", _field_kind(cfg))
    )
    distinct = store(wanted.select("kind", "q_term").distinct(), "wanted-terms",
                     totals={"chars": F.sum(F.length("q_term"))})
    if cfg.fuzzy:
        expanded = expand_terms(distinct.df, vocabulary, index.keys, cfg, distinct.weight)
        # All expansions of a term share the frequency of the most frequent one.
        expansions = Window.partitionBy("field", "q_term")
        expanded = expanded.withColumn("shared_df", F.max("df").over(expansions))
    else:
        named = distinct.df.withColumnRenamed("q_term", "term")
        known = stats_of(vocabulary, named.select("term"))
        expanded = known.join(named, ["kind", "term"]).select("kind", "field", F.col("term").alias("q_term"), "term",
                 F.lit(1.0).alias("boost"), "df", F.col("df").alias("shared_df"))
    stats = index.field_stats.select("field", "n_docs", "avgdl")
    n, df = F.col("n_docs"), F.col("shared_df")
    idf = F.log(1.0 + (n - df + 0.5) / (df + 0.5))
    return (
        wanted.join(expanded, ["kind", "q_term"])
        .join(F.broadcast(stats), "field")
        .groupBy("query_id", "field", "term")
        .agg(F.sum(F.col("qtf") * F.col("boost") * idf * _weight_of_field(cfg)).alias("weight"),
             F.first("df").alias("df"), F.first("avgdl").alias("avgdl"))
        .withColumn("term_part", term_part(cfg, F.col("term")))
    )


def bm25_scores(weights: Stored, index: LexicalIndex, cfg: RetrievalConfig) -> DataFrame:
    """``(query_id, doc_id, score)`` for every document that matches a term."""
    return scored_parts(index.parts, weights, cfg).select(
        "query_id", "doc_id", F.round(best_field(cfg), cfg.score_digits).alias("score")
    )


def bm25_top(
    queries: DataFrame, index: LexicalIndex, cfg: RetrievalConfig, depth: int = MAX_DEPTH
) -> DataFrame:
    """The ``depth`` best documents of every query: ``(query_id, rank, doc_id, score)``.

    Within a field the terms add up; over the fields the best one counts.
    """
    weights = store(query_weights(queries, index, cfg), "query-weights", totals={"chars": F.sum(F.length("term"))})
    if weights.weight <= cfg.broadcast_rows:
        scores = best_scored(index.parts, weights, cfg, depth)
    else:
        scores = bm25_scores(weights, index, cfg)
    ranked = top_k(scores, ["query_id"], [F.desc("score"), F.asc("doc_id")], depth)
    return ranked.select("query_id", "rank", "doc_id", "score")
