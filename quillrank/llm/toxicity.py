"""Toxicity: FTRL-proximal logistic regression over hashed n-grams and skip-grams.

Features of a text are the hashed words, pairs of neighbours, and pairs with one
word between them, each counted once per text. Words are runs of letters, digits
and non-ASCII bytes, lower-cased in A-Z. FTRL-proximal gives every coordinate its
own rate and, by its L1 term, leaves few weights other than zero; only those are
broadcast.

Defined results: null and empty texts have no features and get the score of the
intercept. Rows are scored one by one, so repeated rows get equal scores. A null
id is never held out and never a training row. Without labels every score is 0.
Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.llm.blocks import LOWER, Block, blocks, combine, mix, over_blocks
from quillrank.llm.tables import remainder, text_rows

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_FOLDS = 5


@dataclass(frozen=True)
class ToxicityConfig:
    """``train_limit`` bounds the labelled sample; the model has at most ``2 ** bits`` weights."""

    bits: int = 20
    train_limit: int = 20_000
    epochs: int = 4
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 0.0


def _features(block: Block, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of a block and the text each belongs to, with repeats."""
    folded = Block(block.first, block.offsets, LOWER[block.data])
    starts, ends, first = folded.tokens(_WORD[folded.data])
    words = folded.hashes(starts, ends)
    owner = np.repeat(np.arange(block.n), np.diff(first))
    near, far = owner[1:] == owner[:-1], owner[2:] == owner[:-2]
    skip = mix(words[:-2] + np.uint64(0xA0761D6478BD642F)) if len(words) > 2 else words[:0]
    found = np.concatenate([
        words, combine(words[:-1], words[1:])[near], combine(skip, words[2:])[far] if len(skip) else skip,
    ])
    owners = np.concatenate([owner, owner[1:][near], owner[2:][far] if len(skip) else owner[:0]])
    return (found >> np.uint64(64 - bits)).astype(np.int64), owners


def train(texts: list[np.ndarray], labels: np.ndarray, cfg: ToxicityConfig) -> tuple[float, np.ndarray]:
    """FTRL-proximal over the feature sets in the given order; intercept and weights."""
    size = 1 << cfg.bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    l1 = np.full(size + 1, cfg.l1)
    l1[size] = 0.0

    def weights(at: np.ndarray) -> np.ndarray:
        pull = np.abs(z[at]) - l1[at]
        rate = (cfg.beta + np.sqrt(n[at])) / cfg.alpha + cfg.l2
        return np.where(pull > 0, -np.sign(z[at]) * pull / rate, 0.0)

    for _ in range(cfg.epochs):
        for features, label in zip(texts, labels):
            at = np.append(features, size)
            w = weights(at)
            error = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            grown = n[at] + error * error
            z[at] += error - (np.sqrt(grown) - np.sqrt(n[at])) / cfg.alpha * w
            n[at] = grown
    w = weights(np.arange(size + 1))
    return float(w[size]), w[:size]


def training_ids(labels: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` labelled rows outside the held-out fold, the smallest by hash of the id."""
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (remainder(_FOLDS) != 0))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    )


def fit_toxicity(documents: DataFrame, labels: DataFrame, cfg: ToxicityConfig = ToxicityConfig()):
    """Intercept and the non-zero weights (numbers, values); the training rows meet in one task.

    The sample is bounded by ``train_limit`` and turned into feature numbers by
    the tasks that read the texts. None without labelled rows.
    """
    spark = documents.sparkSession
    chosen = training_ids(labels, cfg.train_limit).collect()
    if not chosen:
        return None
    toxic = {r["doc_id"]: r["toxic"] for r in chosen}
    shared = spark.sparkContext.broadcast((np.array(sorted(toxic)), np.array([toxic[k] for k in sorted(toxic)])))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, marks = shared.value
        for batch in batches:
            own = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(ids, own), len(ids) - 1)
            picked = (ids[at] == own) & batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            kept = batch.filter(pa.array(picked))
            ids_kept, labels_kept = own[picked], marks[at[picked]]
            for block in blocks(kept.column("text")):
                features, owner = _features(block, cfg.bits)
                pair = np.unique((owner << cfg.bits) | features)
                cuts = np.searchsorted(pair >> cfg.bits, np.arange(block.n + 1))
                low = (pair & ((1 << cfg.bits) - 1)).astype(np.int32)
                span = slice(block.first, block.first + block.n)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(ids_kept[span], pa.int64()), "toxic": pa.array(labels_kept[span], pa.int32()),
                    "features": pa.array([low[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()),
                })

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, marks, texts = [], [], []
        for batch in batches:
            ids += batch.column("doc_id").to_pylist()
            marks += batch.column("toxic").to_pylist()
            texts += [np.frombuffer(x, np.int32) for x in batch.column("features").to_pylist()]
        if not ids:
            return
        order = sorted(range(len(ids)), key=lambda i: (ids[i] * 2654435761 % 2**32, ids[i], texts[i].tobytes()))
        bias, w = train([texts[i] for i in order], np.array([marks[i] for i in order], float), cfg)
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_pydict({
            "at": pa.array(np.append(at, -1), pa.int64()), "weight": pa.array(np.append(w[at], bias), pa.float64()),
        })

    rows = (
        text_rows(documents).mapInArrow(extract, "doc_id long, toxic int, features binary")
        .groupBy("doc_id").agg(F.min(F.struct("features", "toxic")).alias("row"))
        .select("doc_id", "row.toxic", "row.features").coalesce(1).mapInArrow(learn, "at long, weight double").collect()
    )
    found = {r["at"]: r["weight"] for r in rows}
    if not found:
        return None
    bias = found.pop(-1)
    numbers = np.array(sorted(found), np.int64)
    return bias, numbers, np.array([found[i] for i in numbers])


def score_toxicity(documents: DataFrame, model, cfg: ToxicityConfig = ToxicityConfig()) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        dense = np.zeros(1 << cfg.bits)
        if fitted:
            dense[fitted[1]] = fitted[2]

        def work(block: Block) -> list[np.ndarray]:
            features, owner = _features(block, cfg.bits)
            live = np.flatnonzero(dense[features])
            pair = np.unique((owner[live] << cfg.bits) | features[live])
            total = np.bincount(pair >> cfg.bits, dense[pair & ((1 << cfg.bits) - 1)], block.n)
            return [total + (fitted[0] if fitted else -np.inf)]

        for batch in batches:
            if batch.num_rows:
                (total,) = over_blocks(batch, "text", work)
                score = 1.0 / (1.0 + np.exp(-np.clip(total, -700, 700)))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"),
                    "score": score if fitted else np.zeros(len(score)),
                    "predicted": (score >= 0.5).astype(np.int32),
                })

    rows = text_rows(documents).withColumn("held_out", F.coalesce(remainder(_FOLDS) == 0, F.lit(False)))
    return rows.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")
