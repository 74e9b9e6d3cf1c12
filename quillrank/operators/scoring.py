"""Scores from postings and query weights.

Everything up to the sums per query and document stays in the task that reads
the bucket of the document.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrank.config import RetrievalConfig
from quillrank.sources.workspace import Stored, store

#: Terms of queries in documents that a task adds up at once, and best rows that it keeps.
_PAIRS = 1_000_000
_KEPT = 500_000


def stats_of(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """Statistics of ``terms``: their ``rows`` alone are read on and summed up.

    Updates of an index add signed rows, so a term can have several, and none is left
    of a term whose sum is zero.
    """
    keys = [c for c in rows.columns if c != "df"]
    known = rows.join(terms, "term", "left_semi")
    return known.groupBy(*keys).agg(F.sum("df").alias("df")).where(F.col("df") > 0)


def term_part(cfg: RetrievalConfig, term: Column) -> Column:
    """Folder of the index that holds a term."""
    return F.pmod(F.xxhash64(term), F.lit(cfg.term_partitions)).cast("int")


def matches(postings: DataFrame, weights: Stored, cfg: RetrievalConfig) -> DataFrame:
    """Postings of the weighted terms, once per query that has the term.

    The folder of the index that holds a term is one of the keys, so Spark takes the
    wanted folders from the copied weights at run time and reads no others.
    """
    keys = ["term_part", "field", "term"]
    # True for every row; Spark prunes only by a side that is filtered.
    weighted = weights.df.drop("df").where(F.col("term_part") >= 0)
    if weights.weight <= cfg.broadcast_rows:
        return postings.join(F.broadcast(weighted), keys)
    # Too many query terms to copy to every task: shuffle both sides and spread
    # the postings of a frequent term over several tasks.
    salts = cfg.join_salts
    left = postings.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
    right = weighted.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>"))
    )
    return left.join(right, [*keys, "_salt"])


def _damped(cfg: RetrievalConfig) -> Column:
    """What frequency and length leave of a weight."""
    keyword = [name for name in cfg.field_weights if cfg.is_keyword(name)]
    b = F.when(F.col("field").isin(keyword), F.lit(0.0)).otherwise(F.lit(cfg.b))
    damping = cfg.k1 * (1.0 - b + b * F.col("dl") / F.col("avgdl"))
    return F.col("tf") / (F.col("tf") + damping)


def contributions(matched: DataFrame, cfg: RetrievalConfig) -> DataFrame:
    """``(query_id, doc_id, field, part)``: the weight, damped by frequency and length."""
    return matched.select("query_id", "doc_id", "field", (F.col("weight") * _damped(cfg)).alias("part"))


def field_column(name: str) -> str:
    return f"_{name}"


def field_sums(parts: DataFrame, cfg: RetrievalConfig) -> DataFrame:
    """One row per query and document with the sums of all fields side by side."""
    return parts.groupBy("query_id", "doc_id").agg(*[
        F.sum(F.when(F.col("field") == name, F.col("part"))).alias(field_column(name))
        for name in cfg.field_weights
    ])


def scored_parts(
    parts: Sequence[DataFrame], weights: Stored, cfg: RetrievalConfig
) -> DataFrame:
    """Field sums over an index of several parts; a document is in one part only."""
    return reduce(DataFrame.unionByName, [
        field_sums(contributions(matches(part, weights, cfg), cfg), cfg) for part in parts
    ])


def best_field(cfg: RetrievalConfig) -> Column:
    sums = [F.col(field_column(name)) for name in cfg.field_weights]
    return F.greatest(*sums) if len(sums) > 1 else sums[0]


def best_scored(parts: Sequence[DataFrame], weights: Stored, cfg: RetrievalConfig, depth: int) -> DataFrame:
    """``(query_id, doc_id, score)``: of every task at least the ``depth`` best documents of every query.

    A posting is read once, however many queries have its term: the postings of a
    document meet in the task of its bucket, which adds up blocks of documents for all
    queries and keeps the best. Only for weights that may be copied to every task.
    """
    spark, keys = weights.df.sparkSession, ["term_part", "field", "term"]
    places = F.create_map(*[F.lit(x) for pair in zip(cfg.field_weights, range(len(cfg.field_weights))) for x in pair])
    numbered = store(
        weights.df.groupBy(*keys).agg(F.first("avgdl").alias("avgdl"), F.collect_list(F.struct("query_id", "weight")).alias("asked"))
        .withColumn("_number", F.monotonically_increasing_id()).withColumn("_place", F.element_at(places, F.col("field"))),
        "numbered-terms").df
    pairs = numbered.select("_number", "_place", F.inline("asked")).toArrow()
    shared = spark.sparkContext.broadcast(_query_lists(pairs))
    # True for every row; Spark prunes only by a side that is filtered.
    named = F.broadcast(numbered.drop("asked", "_place").where(F.col("term_part") >= 0))
    found = F.struct("_number", _damped(cfg).alias("share"))
    # No shuffle: stored postings are in the bucket of their document.
    documents = [
        part.join(named, keys).groupBy("doc_id").agg(F.collect_list(found).alias("found")) for part in parts
    ]
    kept = _best_of_task(shared, len(cfg.field_weights), depth, cfg.score_digits)
    return reduce(DataFrame.unionByName, [
        rows.mapInArrow(kept, "query_id string, doc_id string, score double") for rows in documents
    ])


def _query_lists(pairs: pa.Table) -> tuple:
    """Weighted queries by the number of their term, and the names of the queries."""
    import numpy as np

    if not pairs.num_rows:
        return None
    coded = pairs.column("query_id").combine_chunks().dictionary_encode()
    numbers = pairs.column("_number").to_numpy()
    order = np.argsort(numbers, kind="stable")
    terms, first = np.unique(numbers[order], return_index=True)
    return (
        terms, np.append(first, len(order)), pairs.column("_place").to_numpy()[order][first],
        coded.indices.to_numpy()[order], pairs.column("weight").to_numpy()[order],
        np.asarray(coded.dictionary.to_pylist(), dtype=object),
    )


def _best_of_task(shared, fields: int, depth: int, digits: int):
    """Partition function: best ``depth`` documents of every query among documents with their found terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        if shared.value is None:
            return
        terms, first, place, asked, weight, names = shared.value
        fan, queries = np.diff(first), len(names)
        floor, last = np.full(queries, -np.inf), np.full(queries, "", dtype=object)
        nothing = (np.empty(0, np.int64), np.empty(0, object), np.empty(0))
        best, waiting = nothing, []

        def reduced() -> tuple:
            owner, ids, score = (np.concatenate(column) for column in zip(best, *waiting))
            order = np.lexsort((ids.astype(str), -score, owner))
            owner, ids, score = owner[order], ids[order], score[order]
            rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
            # No later row behind the last of these can be among the best, also not one with its score.
            ends = rank == depth - 1
            floor[owner[ends]], last[owner[ends]] = score[ends], ids[ends]
            return owner[rank < depth], ids[rank < depth], score[rank < depth]

        def rows(found: tuple) -> pa.RecordBatch:
            owner, ids, score = found
            return pa.RecordBatch.from_pydict({
                "query_id": pa.array(list(names[owner]), pa.string()), "doc_id": pa.array(list(ids), pa.string()),
                "score": pa.array(score, pa.float64()),
            })

        def scored(at, share, document, size: int) -> tuple:
            """Query, document of the block and score of all pairs that share a term."""
            times = fan[at]
            pair = np.arange(times.sum()) + np.repeat(first[at] - (np.cumsum(times) - times), times)
            part = weight[pair] * np.repeat(share, times)
            cell = np.repeat(place[at] * size + document, times) * queries + asked[pair]
            cells = fields * size * queries
            if 4 * len(cell) >= cells:
                known = np.zeros(cells, bool)
                known[cell] = True
                sums = np.where(known, np.bincount(cell, part, cells), -np.inf).reshape(fields, -1).max(axis=0)
                used = np.flatnonzero(sums > -np.inf)
                values = sums[used]
            else:
                distinct, inverse = np.unique(cell, return_inverse=True)
                used, inner = np.unique(distinct % (size * queries), return_inverse=True)
                values = np.full(len(used), -np.inf)
                np.maximum.at(values, inner, np.bincount(inverse, part, len(distinct)))
            return used % queries, used // queries, np.round(values, digits)

        for batch in batches:
            ids, found = np.asarray(batch.column("doc_id").to_pylist(), dtype=object), batch.column("found")
            in_order, order = np.unique(ids.astype(str), return_inverse=True)
            before = np.searchsorted(in_order, last.astype(str))
            ends = np.concatenate([[0], np.cumsum(np.diff(found.offsets.to_numpy()))])
            terms_found = found.flatten()
            at = np.searchsorted(terms, terms_found.field("_number").to_numpy())
            share = terms_found.field("share").to_numpy()
            pairs = np.concatenate([[0], np.cumsum(fan[at])])[ends]
            start = 0
            while start < len(ids):
                stop = max(start + 1, int(np.searchsorted(pairs, pairs[start] + _PAIRS, side="right")) - 1)
                piece = slice(ends[start], ends[stop])
                document = np.repeat(np.arange(stop - start), np.diff(ends[start : stop + 1]))
                owner, document, score = scored(at[piece], share[piece], document, stop - start)
                good = (score > floor[owner]) | (
                    (score == floor[owner]) & (order[start + document] < before[owner]))
                waiting.append((owner[good], ids[start + document[good]], score[good]))
                start = stop
                if sum(len(w[0]) for w in waiting) > max(_KEPT // 4, len(best[0])):
                    best = reduced()
                    waiting.clear()
                    before = np.searchsorted(in_order, last.astype(str))
                    if len(best[0]) > _KEPT:
                        yield rows(best)
                        best = nothing
        yield rows(reduced())

    return run
