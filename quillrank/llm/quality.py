"""Quality rules: hashed n-gram log-likelihood ratio between trusted and raw text.

Two multinomials over hashed word 1- and 2-grams are counted: one over all
documents, one over every second of all trusted labelled documents. A document's
score is the mean of ``log p_trusted - log p_raw`` over its n-grams. Documents
below a fixed threshold, taken from all the other trusted documents, which the counts
have not seen, fail; nothing is drawn at random.

Defined results: a null text is an empty one and fails the base rules. Rows are
judged one by one, so repeated rows get equal verdicts, and null or repeated ids
do not matter (a row with a null id cannot be trusted). Without trusted labels
the verdict is that of the base rules. Empty tables give no rows. Extra columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillrank.llm.blocks import SPACE, Block, combine, mix, over_blocks
from quillrank.llm.tables import summed_vectors, text_rows, vector_pieces
from quillrank.sources.workspace import Stored, store

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_PIECES = 16


@dataclass(frozen=True)
class QualityConfig:
    """``trusted_limit`` takes that many trusted documents, the smallest by hash; None takes all.

    ``tail`` is the part of unseen trusted documents that may fall below the
    threshold, which is then lowered by ``margin`` nats for each n-gram. Up to
    ``broadcast_rows`` ids are copied to the tasks that read the texts, more are joined.
    """

    buckets: int = 1 << 16
    smoothing: float = 0.5
    trusted_limit: int | None = None
    broadcast_rows: int = 2_000_000
    tail: float = 0.002
    margin: float = 0.1
    min_words: int = 50


@dataclass(frozen=True)
class QualityModel:
    log_ratio: np.ndarray
    threshold: float


def _grams(block: Block, buckets: int) -> tuple[np.ndarray, np.ndarray, tuple]:
    """Buckets of all 1- and 2-grams and the text each belongs to."""
    starts, ends, first = block.tokens(~SPACE[block.data])
    words = block.hashes(starts, ends)
    owner = np.repeat(np.arange(block.n), np.diff(first))
    follows = owner[1:] == owner[:-1]
    pairs = combine(words[:-1], words[1:])[follows]
    mask = np.uint64(buckets - 1)
    grams = np.concatenate([words & mask, pairs & mask]).astype(np.int64)
    return grams, np.concatenate([owner, owner[1:][follows]]), (starts, ends, first, words, owner)


def _trusted(labels: DataFrame, limit: int | None) -> DataFrame:
    rows = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return rows if limit is None else rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def trusted_ids(labels: DataFrame, limit: int | None = None) -> np.ndarray:
    """Ascending ids of the documents with quality 1, to look at; the counts do not go through it."""
    return np.sort(np.array([r[0] for r in _trusted(labels, limit).collect()], np.int64))


def trusted_halves(labels: DataFrame, limit: int | None = None) -> Stored:
    """``(doc_id, fitted)`` of all trusted documents; every second one by id, from the first, is fitted.

    The ids are sorted in ranges over all tasks, and only the ranges are counted here.
    """
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = store(
        _ranges(_trusted(labels, limit), "doc_id").select("doc_id", F.spark_partition_id().alias("_range"), place.alias("_place")),
        "trusted")
    before, odd = 0, []
    for row in placed.df.groupBy("_range").count().orderBy("_range").collect():
        odd += [row["_range"]] if before % 2 else []
        before += row["count"]
    shift = F.col("_range").isin(odd).cast("int")
    halves = placed.df.select("doc_id", ((F.col("_place") + shift) % 2 == 0).alias("fitted"))
    return replace(placed, df=halves)


def _ranges(rows: DataFrame, column: str) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(parts, column).sortWithinPartitions(column)


def low_quantile(scores: DataFrame, share: float) -> float | None:
    """The quantile of all rows of ``score``, between its two nearest rows; None without rows.

    Scores are counted and sorted in ranges over all tasks; the counts of the ranges say
    in which one a row lies.
    """
    counted = scores.groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    placed = store(_ranges(counted, "score").select("*", F.spark_partition_id().alias("_range")), "ranked-scores").df
    ranges = placed.groupBy("_range").agg(F.sum("n").alias("n")).orderBy("_range").collect()
    total = sum(r["n"] for r in ranges)
    if not total:
        return None
    low = math.floor(share * (total - 1))

    def at(place: int) -> float:
        for r in ranges:
            if place < r["n"]:
                break
            place -= r["n"]
        upto = F.sum("n").over(Window.orderBy("score").rowsBetween(Window.unboundedPreceding, 0))
        inside = placed.where(F.col("_range") == r["_range"]).select("score", upto.alias("upto"))
        return inside.where(F.col("upto") > place).agg(F.min("score")).first()[0]

    return float(np.quantile([at(low), at(min(low + 1, total - 1))], share * (total - 1) - low))


def fit_quality(documents: DataFrame, labels: DataFrame, cfg: QualityConfig = QualityConfig()) -> QualityModel | None:
    """Count both multinomials and set the threshold; None without trusted documents.

    Every second trusted id is kept out of the trusted counts; the threshold is
    taken from those.
    """
    spark = documents.sparkSession
    halves = trusted_halves(labels, cfg.trusted_limit)
    if not halves.rows:
        return None
    known = F.broadcast(halves.df) if halves.rows <= cfg.broadcast_rows else halves.df
    trusted = text_rows(documents).join(known, "doc_id")
    unseen = trusted.where("not fitted") if halves.rows > 1 else trusted

    def counting(kind: str):
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(cfg.buckets, np.int64)

            def work(block: Block) -> tuple:
                nonlocal sums
                sums += np.bincount(_grams(block, cfg.buckets)[0], minlength=cfg.buckets)
                return ()

            for batch in batches:
                over_blocks(batch, "text", work)
            yield vector_pieces({kind: sums}, _PIECES)

        return count

    pieces = "kind string, piece int, counts binary"
    counted = summed_vectors(
        text_rows(documents).mapInArrow(counting("raw"), pieces).unionByName(
            trusted.where("fitted").select("doc_id", "text").mapInArrow(counting("trusted"), pieces)), cfg.buckets)
    if "trusted" not in counted:
        return None
    share = {k: (v + cfg.smoothing) / (v.sum() + cfg.smoothing * cfg.buckets) for k, v in counted.items()}
    log_ratio = np.log(share["trusted"] / share["raw"])
    ratios = spark.sparkContext.broadcast(log_ratio)

    def score_unseen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                scores, longs = over_blocks(batch, "text", lambda b: _llr(b, ratios.value, cfg))
                ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_pydict({"doc_id": ids[longs], "score": scores[longs]})

    # One score per id: an id may stand in any number of rows.
    scored = unseen.select("doc_id", "text").mapInArrow(score_unseen, "doc_id long, score double")
    lowest = low_quantile(scored.groupBy("doc_id").agg(F.min("score").alias("score")), cfg.tail)
    return None if lowest is None else QualityModel(log_ratio, lowest - cfg.margin)


def _llr(block: Block, log_ratio: np.ndarray, cfg: QualityConfig) -> tuple[np.ndarray, np.ndarray]:
    """Score of each text and whether it has the least number of words."""
    grams, owner, found = _grams(block, cfg.buckets)
    total = np.bincount(owner, log_ratio[grams], block.n)
    size = np.bincount(owner, minlength=block.n)
    return total / np.maximum(size, 1), np.diff(found[2]) >= cfg.min_words


def _base(block: Block, found: tuple) -> list[np.ndarray]:
    starts, ends, first, words, owner = found
    inside = ~SPACE[block.data]
    characters = block.per_text(inside & ((block.data & 0xC0) != 0x80))
    symbols = block.per_text(_SYMBOL[block.data])
    tag = mix(np.arange(block.n).astype(np.uint64) + np.uint64(1))

    at, stop, _ = block.tokens(block.data != 10)
    worded = np.searchsorted(starts, stop) > np.searchsorted(starts, at)
    line_owner = block.owner(at[worded])
    lines = combine(block.hashes(at[worded], stop[worded]), tag[line_owner])
    _, once = np.unique(lines, return_index=True)
    repeated_lines = np.bincount(line_owner, minlength=block.n) - np.bincount(line_owner[once], minlength=block.n)

    marks = np.zeros(len(words), bool)
    if len(words) > 2:
        whole = np.flatnonzero(owner[2:] == owner[:-2])
        windows = combine(words[whole], words[whole + 1], words[whole + 2], tag[owner[whole]])
        order = np.argsort(windows)
        same = windows[order[1:]] == windows[order[:-1]]
        again = np.zeros(len(windows), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        for shift in range(3):
            marks[whole[again] + shift] = True
    repeats = np.bincount(owner[marks], minlength=block.n)
    return [np.diff(first), characters, symbols, repeated_lines, repeats]


def judge_quality(documents: DataFrame, model: QualityModel | None, cfg: QualityConfig = QualityConfig()) -> DataFrame:
    """``doc_id``, the counts of the base rules, ``base_failed``, ``kept`` and ``score`` for every row.

    ``n_repeat_words`` counts the words that lie in a 3-word window found twice
    or more in the text; ``n_dup_lines`` lines with a word that equal an earlier one.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value

        def work(block: Block) -> list[np.ndarray]:
            grams, owner, found = _grams(block, cfg.buckets)
            ratio = fitted.log_ratio[grams] if fitted else np.zeros(len(grams))
            size = np.bincount(owner, minlength=block.n)
            return [*_base(block, found), np.bincount(owner, ratio, block.n) / np.maximum(size, 1)]

        for batch in batches:
            if not batch.num_rows:
                continue
            *counts, score = over_blocks(batch, "text", work)
            n_words, repeats = counts[0], counts[4]
            failed = (n_words < cfg.min_words) | (100 * repeats > 50 * n_words)
            kept = ~failed & (score >= (fitted.threshold if fitted else -math.inf))
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), **{k: v.astype(np.int64) for k, v in zip(names, counts)},
                "base_failed": failed, "kept": kept, "score": score,
            })

    schema = "doc_id long, " + ", ".join(f"{n} long" for n in names) + ", base_failed boolean, kept boolean, score double"
    return text_rows(documents).mapInArrow(judge, schema)
