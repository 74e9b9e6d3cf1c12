"""Language identification: multinomial naive Bayes over hashed character n-grams.

Character 1-, 2- and 3-grams of the text, lower-cased in A-Z, with white space and
ASCII digits and punctuation taken as one separator, are hashed into buckets. All
learning documents are counted, whatever their number; the matrix of log
probabilities has one row per bucket and one column per language and is
broadcast. Scoring is a gather and a sum over each text.

Defined results: ``und`` with score 0 for a null text, a text without a letter,
or when nothing was learned. Otherwise ``score`` is the posterior probability of
the language after ``evidence`` n-grams, so that long texts do not all reach 1.
Ties go to the language that sorts first. Rows are judged one by one, so repeated
rows agree; a null id is not held out. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.llm.blocks import LOWER, Block, blocks, over_blocks
from quillrank.llm.tables import remainder, summed_vectors, text_rows, vector_pieces

_PIECES = 16
_CLASS = LOWER.copy()
_CLASS[[i for i in range(128) if not chr(i).isalpha()]] = 32
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


@dataclass(frozen=True)
class LanguageConfig:
    """``held_out`` is the remainder of crc32(id) modulo 4 that is not learned from."""

    buckets: int = 1 << 15
    sizes: tuple[int, ...] = (1, 2, 3)
    smoothing: float = 0.5
    evidence: int = 400
    held_out: int = 2


@dataclass(frozen=True)
class LanguageModel:
    names: list[str]
    log_prob: np.ndarray
    log_prior: np.ndarray


def _grams(block: Block, cfg: LanguageConfig) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character n-grams of a block and the text each belongs to.

    Runs of separators count as one character.
    """
    data = _CLASS[block.data]
    blank = data == 32
    keep = np.ones(len(data), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    short = Block(block.first, np.concatenate([[0], np.cumsum(keep)])[block.offsets], data[keep])
    at = np.flatnonzero((short.data & 0xC0) != 0x80)
    first = np.searchsorted(at, short.offsets)
    owner = np.repeat(np.arange(block.n), np.diff(first))
    edge = np.append(at, len(short.data))
    found, owners = [], []
    for n in cfg.sizes:
        if len(at) < n:
            continue
        whole = owner[n - 1 :] == owner[: len(owner) - n + 1]
        begin = np.flatnonzero(whole)
        found.append(short.hashes(edge[begin], edge[begin + n]) & np.uint64(cfg.buckets - 1))
        owners.append(owner[begin])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found).astype(np.int64), np.concatenate(owners)


def fit_language(documents: DataFrame, cfg: LanguageConfig = LanguageConfig()) -> LanguageModel | None:
    """Count n-grams of every learning document by language. None if there is none."""
    learning = documents.where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder(4) != cfg.held_out)
    ).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names, codes = np.unique(batch.column("lang").to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
            for name in names:
                sums.setdefault(str(name), np.zeros(cfg.buckets + _PIECES, np.int64))
            for block in blocks(batch.column("text")):
                grams, owner = _grams(block, cfg)
                lang = codes[block.first : block.first + block.n]
                flat = np.bincount(lang[owner] * cfg.buckets + grams, minlength=len(names) * cfg.buckets)
                for name, part, texts in zip(names, flat.reshape(len(names), -1), np.bincount(lang, minlength=len(names))):
                    sums[str(name)][: cfg.buckets] += part
                    sums[str(name)][cfg.buckets] += texts
        if sums:
            yield vector_pieces(sums, _PIECES)

    counted = summed_vectors(
        learning.mapInArrow(count, "kind string, piece int, counts binary"), cfg.buckets + _PIECES
    )
    if not counted:
        return None
    names = sorted(counted)
    table = np.stack([counted[n] for n in names], 1)
    grams = table[: cfg.buckets] + cfg.smoothing
    texts = table[cfg.buckets]
    return LanguageModel(names, np.log(grams / grams.sum(0)), np.log(texts / texts.sum()))


def _lettered(block: Block) -> np.ndarray:
    """Whether each text has a letter of any script."""
    found = block.per_text(_LETTER[block.data]) > 0
    for i in np.flatnonzero(~found):
        text = block.data[block.offsets[i] : block.offsets[i + 1]].tobytes()
        found[i] = any(c.isalpha() for c in text.decode("utf-8", "ignore"))
    return found


def predictor(model: LanguageModel | None, cfg: LanguageConfig = LanguageConfig()):
    """A function from a batch with ``text`` to predicted names and scores."""

    def work(block: Block) -> list[np.ndarray]:
        if model is None:
            return [np.full(block.n, -1), np.zeros(block.n)]
        grams, owner = _grams(block, cfg)
        n = np.bincount(owner, minlength=block.n)
        sums = np.stack([np.bincount(owner, column[grams], block.n) for column in model.log_prob.T], 1)
        sums = sums * np.minimum(1.0, cfg.evidence / np.maximum(n, 1))[:, None] + model.log_prior
        best = sums.argmax(1)
        score = 1.0 / np.exp(sums - sums.max(1, keepdims=True)).sum(1)
        lettered = _lettered(block)
        return [np.where(lettered, best, -1), np.where(lettered, score, 0.0)]

    def predict(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        best, score = over_blocks(batch, "text", work)
        names = np.array([*(model.names if model else []), "und"], object)
        return names[best], score

    return predict


def identify_language(documents: DataFrame, model: LanguageModel | None, cfg: LanguageConfig = LanguageConfig()) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = predictor(shared.value, cfg)
        for batch in batches:
            if batch.num_rows:
                names, score = predict(batch)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"),
                    "lang_pred": pa.array(names, pa.string()), "score": score,
                })

    rows = text_rows(documents).withColumn("held_out", F.coalesce(remainder(4) == cfg.held_out, F.lit(False)))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(documents: DataFrame, model: LanguageModel | None, least: float = 0.5,
                    cfg: LanguageConfig = LanguageConfig()) -> DataFrame:
    """The rows, unchanged, whose language is known with a score of at least ``least``."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    plain = documents.withColumn("text", F.col("text").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = predictor(shared.value, cfg)
        for batch in batches:
            if batch.num_rows:
                names, score = predict(batch)
                yield batch.filter(pa.array((names != "und") & (score >= least)))

    return plain.mapInArrow(run, plain.schema)
