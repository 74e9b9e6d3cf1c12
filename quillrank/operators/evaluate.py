"""Known-item queries and the quality of ranked lists."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrank.config import EVAL_CUTOFFS, EVAL_METRIC_DEPTH, STYLE_LABELS
from quillrank.functions.lets import let
from quillrank.functions.text import (
    split_words, synopsis_authors, synopsis_subjects, synopsis_year,
)
from quillrank.operators.topk import first_n


def _draw(seed: int, *parts: Column) -> Column:
    """Hex digits that look random but repeat for the same seed and parts."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


def _choice(seed: int, size: Column, *parts: Column) -> Column:
    """A repeatable number in ``1..size``."""
    digits = F.conv(F.substring(_draw(seed, *parts), 1, 8), 16, 10).cast("bigint")
    return (F.pmod(digits, size) + 1).cast("int")


def keyword_query(seed: int) -> Column:
    """Up to three longer words of the title; needs at least two."""
    words = F.filter(split_words(F.col("title")), lambda w: F.length(w) > 3)

    def sampled(found: Column) -> Column:
        shuffled = F.array_sort(F.transform(
            found, lambda w: F.struct(_draw(seed, F.col("doc_id"), w).alias("draw"), w.alias("word"))
        ))
        picked = F.transform(F.slice(shuffled, 1, 3), lambda s: s["word"])
        return F.when(F.size(found) >= 2, F.array_join(picked, " "))

    return let(words, sampled)


def author_query(seed: int) -> Column:
    """Asks for the first author named in the synopsis."""
    return F.concat(F.lit("books by "), F.get(synopsis_authors(F.col("synopsis")), F.lit(0)))


def subject_query(seed: int) -> Column:
    """One of the first three subjects named in the synopsis."""

    def picked(subjects: Column) -> Column:
        place = _choice(seed, F.size(subjects), F.col("doc_id"), F.lit("subject"))
        return F.when(F.size(subjects) > 0, F.get(subjects, place - 1))

    return let(F.slice(synopsis_subjects(F.col("synopsis")), 1, 3), picked)


def year_query(seed: int) -> Column:
    """The first subject together with the year of publication."""
    subject = F.get(synopsis_subjects(F.col("synopsis")), F.lit(0))
    return F.concat(subject, F.lit(" from "), synopsis_year(F.col("synopsis")))


STYLES: dict[str, Callable[[int], Column]] = {
    "keyword": keyword_query,
    "author": author_query,
    "subject": subject_query,
    "year": year_query,
}


def styled_queries(documents: DataFrame, style: str, seed: int) -> DataFrame:
    """The query of one style for every document that allows it."""
    made = documents.withColumn("query", STYLES[style](seed)).where(
        F.col("query").isNotNull() & (F.col("query") != "")
    )
    return _labelled(made.withColumn("style", F.lit(style)))


def _labelled(made: DataFrame) -> DataFrame:
    return made.select(
        F.col("doc_id").alias("query_id"), "query", F.col("doc_id").alias("relevant_id"), "style", "title"
    )


def generate_queries(documents: DataFrame, n: int, styles: Sequence[str], seed: int) -> DataFrame:
    """``n`` known-item queries over documents and styles drawn at random.

    Unknown styles are ignored. The draw depends only on ``seed`` and the
    document id. Query text is only built for drawn documents.
    """
    known = [s for s in styles if s in STYLES]
    if not known:
        return _labelled(documents.select("*", F.lit("").alias("query"), F.lit("").alias("style"))
                         .where(F.lit(False)))
    pick = _choice(seed, F.lit(len(known)), F.col("doc_id"), F.lit("style"))
    made = documents.withColumn("style", F.element_at(F.array(*[F.lit(s) for s in known]), pick))
    text = F.coalesce(*[F.when(F.col("style") == s, STYLES[s](seed)) for s in known])
    asked = made.withColumn("query", text).where(F.col("query").isNotNull() & (F.col("query") != ""))
    drawn = asked.withColumn("_draw", _draw(seed, F.col("doc_id")))
    return _labelled(first_n(drawn, [F.asc("_draw"), F.asc("doc_id")], n))


def style_counts(qrels: DataFrame) -> DataFrame:
    labels = F.create_map(*[F.lit(x) for pair in STYLE_LABELS.items() for x in pair])
    return qrels.groupBy("style").agg(F.count(F.lit(1)).alias("n_queries")).select(
        "style", F.element_at(labels, F.col("style")).alias("label"), "n_queries"
    )


def _share_within(k: int) -> Column:
    return F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0))


def _mean_gain(gain: Column) -> Column:
    counted = F.col("rank") <= EVAL_METRIC_DEPTH
    return F.avg(F.when(counted, gain).otherwise(0.0))


def metric_columns(cutoffs: Sequence[int] = EVAL_CUTOFFS) -> dict[str, Column]:
    """Aggregates over judged queries; a query that found nothing counts as zero."""
    metrics = {f"Hit@{k}": _share_within(k) for k in cutoffs}
    metrics[f"MRR@{EVAL_METRIC_DEPTH}"] = _mean_gain(1.0 / F.col("rank"))
    metrics[f"NDCG@{EVAL_METRIC_DEPTH}"] = _mean_gain(1.0 / F.log2(F.col("rank") + 1.0))
    return metrics


def metrics_long(judged_runs: DataFrame, cutoffs: Sequence[int] = EVAL_CUTOFFS) -> DataFrame:
    """``(method, metric, value)`` in one aggregation over all methods."""
    columns = metric_columns(cutoffs)
    wide = judged_runs.groupBy("method").agg(*[c.alias(name) for name, c in columns.items()])
    return wide.unpivot(["method"], list(columns), "metric", "value")


def metrics_wide(
    long: DataFrame, cutoffs: Sequence[int] = EVAL_CUTOFFS, digits: int = 4
) -> DataFrame:
    """One row per method, one column per metric."""
    names = list(metric_columns(cutoffs))
    return long.groupBy("method").pivot("metric", names).agg(F.round(F.first("value"), digits))
