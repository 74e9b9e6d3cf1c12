"""Expansion of query terms to similar indexed terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrank.config import RetrievalConfig
from quillrank.functions.edits import allowed_edits, edits_within_two, may_be_near, most_keys, probe_keys, vocabulary_keys
from quillrank.operators.scoring import stats_of
from quillrank.operators.topk import top_k
from quillrank.sources.workspace import store


KEY_PART = "_part"
# No query word has more keys than this, so the number of words bounds the keys.
KEYS_PER_WORD = 211
#: Keys that one task sorts and writes, into a file for each part.
_KEYS_PER_TASK = 4_600_000


def _key_part(parts: int) -> Column:
    return F.pmod(F.col("_key"), F.lit(parts)).cast("int").alias(KEY_PART)


def keys_of(terms: DataFrame, parts: int) -> DataFrame:
    """``(_key, term, _part)``: every indexed term under all keys by which it can be found.

    The terms are small but each one is a lot of work, so they are spread over all
    cores, in parts whose keys fit into memory to be sorted and written where they are. Made once when an index is built, one
    folder for each ``_part``; searches only read it.
    """
    cores = terms.sparkSession.sparkContext.defaultParallelism
    known = terms.agg(F.sum(most_keys(F.col("term"))).alias("keys")).first()["keys"] or 0
    tasks = max(cores, -(-known // _KEYS_PER_TASK))
    distinct = terms.select("term").repartition(tasks, "term").distinct()
    keyed = distinct.select(F.explode(vocabulary_keys(F.col("term"))).alias("_key"), "term")
    return keyed.select("_key", "term", _key_part(parts))


def similar_terms(
    wanted: DataFrame, keys: DataFrame, cfg: RetrievalConfig, wanted_rows: int
) -> DataFrame:
    """Pairs ``(kind, q_term, term, edits)`` within the allowed number of edits.

    ``wanted`` holds distinct ``(kind, q_term)``, ``keys`` is the table of an index.
    Query words are turned into keys and joined with it, and the distance is computed
    once per candidate pair. Few query words are copied to the tasks that read the
    keys, which then are not shuffled, and only the folders of their keys are read. Whether a term exists in a field of the kind is
    left to the join with the vocabulary.
    """
    probes = wanted.select(
        "kind", "q_term", allowed_edits(F.col("q_term")).alias("allowed"),
        F.explode(F.array_distinct(probe_keys(F.col("q_term")))).alias("_key"),
    ).select("*", _key_part(cfg.key_partitions)).where(F.col(KEY_PART) >= 0)  # true; it allows pruning
    if wanted_rows * KEYS_PER_WORD <= cfg.broadcast_rows:
        probes = F.broadcast(probes)
    # Most candidates are dropped before they move.
    close = may_be_near(F.col("q_term"), F.col("term"), F.col("allowed"))
    candidates = (
        keys.join(probes, [KEY_PART, "_key"]).where(close)
        .groupBy("kind", "term", "q_term").agg(F.first("allowed").alias("allowed"))
    )
    # A one-element generator keeps the distance from being computed for the filter again.
    edits = F.explode(F.array(edits_within_two(F.col("q_term"), F.col("term")))).alias("edits")
    return (
        candidates.select("kind", "q_term", "term", "allowed", edits)
        .where(F.col("edits") <= F.col("allowed"))
        .select("kind", "q_term", "term", "edits")
    )


def expand_terms(
    wanted: DataFrame, vocabulary: DataFrame, keys: DataFrame, cfg: RetrievalConfig, wanted_rows: int
) -> DataFrame:
    """``(kind, field, q_term, term, edits, boost, df)``.

    Every query term keeps its ``max_expansions`` closest terms of each field;
    equally close ones are taken in alphabetical order. The number is part of the
    definition of fuzzy matching, not a limit on work.

    The pairs are written and counted first. Few of them are copied to the tasks that
    read the vocabulary, ``(kind, field, term, df)``; only its rows of similar terms are
    shuffled, to be summed up where updates have added to it.
    """
    pairs = store(similar_terms(wanted, keys, cfg, wanted_rows), "similar-terms",
                  totals={"chars": F.sum(F.length("term") + F.length("q_term"))})
    similar = F.broadcast(pairs.df) if pairs.weight <= cfg.broadcast_rows else pairs.df
    known = stats_of(vocabulary, similar.select("term"))
    shorter = F.least(F.length("q_term"), F.length("term"))
    boosted = known.join(similar, ["kind", "term"]).withColumn(
        "boost", 1.0 - F.col("edits") / shorter
    )
    best = top_k(
        boosted, ["field", "q_term"], [F.desc("boost"), F.asc("term")], cfg.max_expansions, "_place"
    )
    return best.select("kind", "field", "q_term", "term", "edits", "boost", "df")
