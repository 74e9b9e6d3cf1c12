"""From documents to a searchable index."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.config import RetrievalConfig
from quillrank.functions.embedders import Embedder
from quillrank.operators.corpus import documents_named, embed, spread, store_corpus
from quillrank.operators.dense import CellIndex, build_cells, change_cells
from quillrank.operators.lexical import (
    LexicalIndex, analyze, build_lexical_index, length_totals, postings_of, term_stats_of, with_average,
)
from quillrank.sources.workspace import bucket_count, store


@dataclass(frozen=True)
class SearchIndex:
    """Stored corpus with vectors, the lexical index over it, and the write counts.

    ``cells`` are the vectors once more, grouped for approximate search, ``buckets``
    the number of buckets of an index in one part.
    """

    corpus: DataFrame
    lexical: LexicalIndex
    embedder: Embedder
    counts: dict[str, int]
    cells: CellIndex | None = None
    buckets: int | None = None

    @property
    def vectors(self) -> DataFrame:
        return self.corpus.select("doc_id", "vector")


def bulk_index(
    documents: DataFrame, embedder: Embedder, cfg: RetrievalConfig, order: list[str] | None = None
) -> SearchIndex:
    """Embed normalised documents, store them, and index the stored rows.

    Every document moves once, to the task of its bucket; embedding, storing and
    analysing happen there. Documents that cannot be stored do not stop the job,
    they are counted. Vectors that are already there are kept. Of rows with the
    same id the last one counts: by the columns of ``order``, or else by all
    columns as they stand.
    """
    buckets = bucket_count(documents.sparkSession, cfg.index_buckets, documents)
    placed = _last_written(spread(documents, buckets), order)
    vectors = placed if "vector" in documents.columns else embed(placed, embedder)
    corpus, counts = store_corpus(vectors, embedder.dim, buckets)
    return SearchIndex(corpus, build_lexical_index(corpus, cfg, buckets), embedder, counts, buckets=buckets)


def with_cells(index: SearchIndex, cells: int | None = None, **settings) -> SearchIndex:
    """The index with its vectors grouped into cells; ``settings`` are those of ``build_cells``.

    Searches use them when ``probes`` is set in their configuration.
    """
    return replace(index, cells=build_cells(index.vectors, cells, **settings))


def _last_written(documents: DataFrame, order: list[str] | None) -> DataFrame:
    """One row per id; rows without an id stay, to be counted as failed.

    The rows of an id are in one task already, so nothing moves.
    """
    unnamed = F.coalesce(F.col("doc_id"), F.lit("")) == ""
    columns = [c for c in documents.columns if c != "doc_id"]
    row = F.struct(*columns)
    last = F.max_by(row, F.struct(*order)) if order else F.max(row)
    rows = documents.withColumn("_unnamed", F.when(unnamed, F.monotonically_increasing_id()))
    newest = rows.groupBy("doc_id", "_unnamed").agg(last.alias("_row"))
    return newest.select("doc_id", "_row.*")


def apply_changes(index: SearchIndex, documents: DataFrame, cfg: RetrievalConfig) -> SearchIndex:
    """The index after an upsert of ``documents``, at the cost of the changes.

    New versions become a part of their own, older versions of the same documents
    are skipped while reading, and the statistics are corrected, so that results
    equal those of an index built from scratch. What the older versions counted is
    taken from their stored texts, found by id; postings are not read. Term statistics
    get signed rows for the difference, which a search sums for its own terms.
    ``rebuild`` merges the parts.
    """
    change = bulk_index(documents, index.embedder, cfg)
    ids = store(change.corpus.select("doc_id"), "changed-ids", totals={"chars": F.sum(F.length("doc_id"))})
    changed = F.broadcast(ids.df) if ids.weight <= cfg.broadcast_rows else ids.df

    replaced = documents_named(index.corpus, ids, cfg).select("doc_id", *cfg.field_weights)
    old = store(postings_of(analyze(replaced, cfg), cfg), "replaced-postings").df
    new = change.lexical
    difference = store(_signed_sum(
        ["field", "term"], ["df"], [new.term_stats], term_stats_of(old)).where(F.col("df") != 0), "term-changes").df
    term_rows = index.lexical.term_log.unionByName(difference)
    term_stats = term_rows.groupBy("field", "term").agg(F.sum("df").alias("df")).where(F.col("df") > 0)
    field_stats = store(with_average(_signed_sum(
        ["field"], ["n_docs", "total_dl"], [index.lexical.field_stats, new.field_stats], length_totals(old)
    ).where(F.col("n_docs") > 0)), "field-stats").df

    # Keys of terms that are gone are harmless: the vocabulary no longer has them.
    keys = index.lexical.keys.unionByName(new.keys)
    kept = tuple(part.join(changed, "doc_id", "left_anti") for part in index.lexical.parts)
    corpus = index.corpus.join(changed, "doc_id", "left_anti").unionByName(change.corpus)
    cells = index.cells and change_cells(index.cells, changed, change.vectors)
    return SearchIndex(
        corpus, LexicalIndex((*kept, *new.parts), term_stats, field_stats, keys, term_rows), index.embedder,
        change.counts, cells,
    )


def _signed_sum(
    keys: list[str], values: list[str], added: list[DataFrame], removed: DataFrame
) -> DataFrame:
    minus = removed.select(*keys, *[(-F.col(v)).alias(v) for v in values])
    rows = reduce(DataFrame.unionByName, [df.select(*keys, *values) for df in (*added, minus)])
    return rows.groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values])


def rebuild(index: SearchIndex, cfg: RetrievalConfig) -> SearchIndex:
    """The same index in one part, with the vectors and the centres it already has."""
    whole = bulk_index(index.corpus, index.embedder, cfg)
    return with_cells(whole, centers=index.cells.centers) if index.cells else whole
