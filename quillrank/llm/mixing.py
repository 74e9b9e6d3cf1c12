"""Mixing sources to target weights by fitting word budgets as a subset sum.

A source whose target is at least its size takes every document once and fills
the rest of its budget with second copies; a smaller target is filled with first
copies. Which documents fill the budget is decided on the counts of documents by
exact length: every length gives the same share of its documents, longer lengths
give one more while it fits, and a bounded-knapsack dynamic program closes the
remaining gap. Where it cannot close it, it gets more of the budget, all of it up to
``exact`` words; up to there the sum is the nearest there is. The documents of a length are then chosen by a seeded order.

Defined results: a null text has size 0 and is never taken beyond its one free
copy (``taken`` is 0). A null source is a source of its own and comes last. Rows
with a null id and repeated rows take part as rows of their own; the order among
fully equal rows does not matter. Sources without words have target 0. Empty
tables give no rows. Extra columns are kept by ``take`` and ignored by ``mix``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillrank.llm.tables import written

_BINS = 1024
WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class MixConfig:
    """``weights`` repeat over the sources in code-point order, nulls last.

    ``share`` is the size of the mix as a part of all words, ``copies`` the most
    a source or document may be repeated. ``gap`` is the budget, in words, that is
    left to the dynamic program at first, ``exact`` what it gets if it misses.
    """

    weights: tuple[float, ...] = (3.0, 1.0, 2.0)
    share: float = 1.5
    copies: int = 2
    gap: int = 20_000
    exact: int = 500_000
    seed: int = 17


def sized(documents: DataFrame) -> DataFrame:
    """``doc_id, source, size`` and a seeded order for every row, written once."""
    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.col("text").cast("string")).alias("_tx"),
    )


def targets(sizes: DataFrame, cfg: MixConfig) -> DataFrame:
    """``source, source_size, target``: one row per source.

    With sources in ascending order of cap over weight, the first ones are those
    that stop at their cap; the others share the rest by weight.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    code = F.col("source").asc_nulls_last()
    place = (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(code)) - 1) % len(cfg.weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in cfg.weights]), (place + 1).cast("int"))
    cap = F.col("source_size") * float(cfg.copies)
    rising = Window.partitionBy(F.lit(0)).orderBy("_ratio", code).rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.partitionBy(F.lit(0)).orderBy("_ratio", code).rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    return (
        by_source.withColumn("_weight", weight).withColumn("_cap", cap)
        .withColumn("_ratio", F.col("_cap") / F.col("_weight"))
        .withColumn("_level", (F.sum("source_size").over(everything) * cfg.share
                               - F.coalesce(F.sum("_cap").over(rising), F.lit(0.0))) / F.sum("_weight").over(onward))
        .withColumn("_rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_ratio", code)))
        .withColumn("_level", F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_rank", "_level"))).over(everything)["_level"])
        .select("source", "source_size",
                F.least("_cap", F.coalesce(F.col("_level") * F.col("_weight"), F.col("_cap"))).alias("target"))
    )


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int, gap: int, exact: int = 500_000) -> np.ndarray:
    """How many documents of each length to take so that their words come nearest to ``budget``.

    ``lengths`` are distinct and positive. Budgets up to ``exact`` get the nearest sum of all.
    """
    total = int((lengths * counts).sum())
    budget = min(max(budget, 0), total)
    nearest, miss = np.zeros(len(lengths), np.int64), budget
    for part in sorted({min(gap, budget // 10), gap, max(gap, exact)}):
        if not miss:
            break
        taken = _filled(lengths, counts, budget, part)
        taken += _knapsack(lengths, counts - taken, budget - int((lengths * taken).sum()))
        off = abs(budget - int((lengths * taken).sum()))
        if off < miss:
            nearest, miss = taken, off
    return nearest


def _filled(lengths: np.ndarray, counts: np.ndarray, budget: int, gap: int) -> np.ndarray:
    """Documents of each length, in proportion, that leave about ``gap`` words of the budget."""
    total, taken = int((lengths * counts).sum()), np.zeros(len(lengths), np.int64)
    # Keep about ``gap`` words, and all that a length's rounding leaves, for later.
    for i, (n, c) in enumerate(zip(lengths.tolist(), counts.tolist())):
        taken[i] = c * max(budget - gap, 0) // total
    left = budget - int((lengths * taken).sum())
    for i in np.argsort(-lengths, kind="stable"):
        if left <= gap:
            break
        more = min(int(counts[i] - taken[i]), (left - gap) // int(lengths[i]))
        taken[i] += more
        left -= more * int(lengths[i])
    return taken


def _knapsack(lengths: np.ndarray, counts: np.ndarray, left: int) -> np.ndarray:
    """Bounded knapsack as a subset sum: for every sum, the part of a count that reached it first.

    Sums up to twice the budget are kept, as the nearest may lie above. Memory is a few
    bytes for each of them, however many documents there are.
    """
    taken = np.zeros(len(lengths), np.int64)
    usable = [int(i) for i in np.flatnonzero(counts > 0) if lengths[i] <= 2 * left]
    if not usable or left <= 0:
        return taken
    sums = 2 * left + 1
    by = np.full(sums, -1, np.int32)  # -1: not reached
    by[0] = 0
    steps: list[tuple[int, int]] = []
    top = 0
    for i in usable:
        rest, part, n = min(int(counts[i]), sums // int(lengths[i])), 1, int(lengths[i])
        while rest > 0:
            part = min(part, rest)
            end = min(top + part * n, sums - 1) + 1  # no sum beyond is reached yet
            new = np.flatnonzero((by[part * n : end] < 0) & (by[: max(end - part * n, 0)] >= 0)) + part * n
            by[new] = len(steps)
            steps.append((i, part))
            top = max(top, int(new[-1])) if len(new) else top
            rest -= part
            part *= 2
        if by[left] >= 0:
            break
    reached = np.flatnonzero(by >= 0)
    hit = int(reached[np.lexsort((reached, np.abs(reached - left)))[0]])
    while hit:
        i, part = steps[by[hit]]
        taken[i] += part
        hit -= part * int(lengths[i])
    return taken


def _quota(histogram: DataFrame, cfg: MixConfig) -> DataFrame:
    """``source, size, base, extra``: copies every document gets, and documents that get one more."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", ignore_index=True)
        lengths, counts = pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
        target, total = float(pdf["target"].iloc[0]), int((lengths * counts).sum())
        base = min(int(target // total), cfg.copies) if total else 0
        budget = int(round(target)) - base * total
        extra = fit_counts(lengths, counts, budget, cfg.gap, cfg.exact) if base < cfg.copies else np.zeros(len(pdf), np.int64)
        return pdf[["source", "size"]].assign(base=np.int64(base), extra=extra)

    return histogram.groupBy("source").applyInPandas(fit, "source string, size long, base long, extra long")


def mix(documents: DataFrame, cfg: MixConfig = MixConfig()) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` and the row's text hash.

    Ranks within a length are counted over bins of the seeded order, so the many
    documents of one length are ranked by many tasks.
    """
    sizes = written(sized(documents), "mix-sizes")
    plan = targets(sizes, cfg)
    histogram = (
        sizes.where("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    )
    known = _same(plan, histogram, ["source"])
    quota = written(_quota(known.select("source", "size", "n", "target"), cfg), "mix-quota")

    order = F.xxhash64(F.lit(cfg.seed), F.col("doc_id"), F.col("_tx"))
    binned = sizes.withColumn("_order", order).withColumn("_bin", F.pmod(F.shiftrightunsigned("_order", 40), F.lit(_BINS)))
    earlier = Window.partitionBy("source", "size").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        binned.where("size > 0").groupBy("source", "size", "_bin").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    )
    starts = _same(quota, starts, ["source", "size"]).select("source", "size", "_bin", "_start", "base", "extra")
    inside = Window.partitionBy("source", "size", "_bin").orderBy("_order", "doc_id", "_tx")
    ranked = binned.withColumn("_place", F.row_number().over(inside))
    chosen = _same(starts, ranked, ["source", "size", "_bin"], "left")
    copies = F.coalesce(
        F.col("base") + F.when(F.col("_start") + F.col("_place") <= F.col("extra"), 1).otherwise(0), F.lit(0)
    )
    # The plan has one row per source and is joined last, on the narrow rows.
    return _same(plan, chosen, ["source"], "left").select(
        "doc_id", "source", "size", "source_size", "target", copies.cast("int").alias("copies"),
        (copies * F.col("size")).cast("long").alias("taken"), "_tx",
    )


def _same(small: DataFrame, rows: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``small`` that has one row per key; null keys are equal."""
    renamed = small.select(*[F.col(k).alias(f"_k_{k}") if k in keys else F.col(k) for k in small.columns])
    on: Column = F.lit(True)
    for k in keys:
        on = on & rows[k].eqNullSafe(renamed[f"_k_{k}"])
    return rows.join(renamed, on, how).drop(*[f"_k_{k}" for k in keys])


def take(documents: DataFrame, cfg: MixConfig = MixConfig()) -> DataFrame:
    """The rows of the mix, unchanged: each document as many times as it is taken.

    Documents without words belong to no budget and are left out. Rows that are
    the same document share one number of copies for all of them.
    """
    chosen = (
        mix(documents, cfg).where("copies > 0")
        .groupBy(F.col("source").alias("_s"), F.col("doc_id").alias("_d"), "_tx").agg(F.sum("copies").alias("_copies"))
    )
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_row")
    keyed = documents.select(
        row, F.col("source").cast("string").alias("_ks"), F.col("doc_id").cast("long").alias("_kd"),
        F.xxhash64(F.col("text").cast("string")).alias("_kt"),
    )
    # Repeats of one document become one row, which then is copied as often as all of them together.
    keyed = keyed.dropDuplicates(["_ks", "_kd", "_kt"])
    match = F.col("_kd").eqNullSafe(F.col("_d")) & F.col("_ks").eqNullSafe(F.col("_s")) & (F.col("_kt") == F.col("_tx"))
    copied = keyed.join(chosen, match).withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    return copied.select("_row.*")
