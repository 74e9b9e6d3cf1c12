"""SimHash near-duplicates: fingerprints of word shingles and a binary-trie self-join.

Links are pairs of fingerprints with at most ``budget`` differing bits. Two such
fingerprints agree in one of ``budget + 1`` fields of bits. For each field the
distinct fingerprints form a trie that starts with that field: the paths of a
linked pair run together through the field without spending budget. Every field
value is the root of a subtrie and a unit of work. Inside it, pairs of nodes go
down together, add up their differing bits and are dropped once these exceed the
budget. A subtrie with too many fingerprints for one task is split by its next
bits first, into the node pairs that are still within the budget.

A subtrie's links are thinned to a spanning forest, so a group of n fingerprints
gives at most n - 1 edges. Components are found by alternating star contraction.

Defined results: a null or empty text has the fingerprint zero, which links like
any other. Repeated rows have equal fingerprints and one component. The smallest
id of a component ignores nulls; a component of null ids only has a null id.
Empty tables give no rows. Extra columns are ignored, or kept by ``one_of_each``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.llm.blocks import LOWER, SPACE, Block, over_blocks
from quillrank.llm.tables import row_key, written

_SHIFT = np.arange(63, -1, -1).astype(np.uint64)


@dataclass(frozen=True)
class SimHashConfig:
    """``task_rows`` is the size from which a subtrie is split by its next ``step`` bits."""

    shingle: int = 3
    budget: int = 2
    seed: int = 42
    task_rows: int = 20_000
    step: int = 8


def shingles(block: Block, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Folded words of the block, one space after each; starts and ends of shingles; number of each text."""
    data = LOWER[block.data]
    folded = Block(block.first, block.offsets, data)
    starts, ends, first = folded.tokens(~SPACE[data])
    # One space after each word, so that a shingle is one slice.
    lengths = ends - starts
    begin = np.concatenate([[0], np.cumsum(lengths + 1)])
    joined = np.full(begin[-1], 32, np.uint8)
    at = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    joined[at + np.repeat(begin[:-1], lengths)] = data[at + np.repeat(starts, lengths)]

    n = np.diff(first)
    count = np.where(n > 0, np.maximum(n - width + 1, 1), 0)
    within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    head = np.repeat(first[:-1], count) + within
    tail = np.minimum(head + width, np.repeat(first[1:], count))
    return joined, begin[head], begin[tail] - 1, count


def fingerprint_block(block: Block, cfg: SimHashConfig) -> np.ndarray:
    joined, starts, ends, count = shingles(block, cfg.shingle)
    text = joined.tobytes()
    edge = np.concatenate([[0], np.cumsum(count)])
    digest, seed = xxhash.xxh64_intdigest, cfg.seed
    hashes = np.fromiter(
        (digest(text[a:b], seed) for a, b in zip(starts.tolist(), ends.tolist())), np.uint64, len(starts),
    )
    out = np.zeros(block.n, np.uint64)
    filled = np.flatnonzero(count)
    if len(filled):
        for shift in range(64):
            ones = np.add.reduceat((hashes >> np.uint64(shift)) & np.uint64(1), edge[filled])
            out[filled] |= (2 * ones.astype(np.int64) > count[filled]).astype(np.uint64) << np.uint64(shift)
    return out


def fingerprints(documents: DataFrame, cfg: SimHashConfig = SimHashConfig()) -> DataFrame:
    """``doc_id, _id, _tx, fp`` for every row; ``fp`` is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                (fp,) = over_blocks(batch, "text", lambda block: [fingerprint_block(block, cfg)])
                yield pa.RecordBatch.from_pydict({
                    **{c: batch.column(c) for c in ("doc_id", "_id", "_tx")}, "fp": fp.view(np.int64),
                })

    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *row_key()
    )
    return rows.mapInArrow(run, "doc_id long, _id long, _tx long, fp long")


def _fields(budget: int) -> list[tuple[int, int]]:
    """``budget + 1`` fields (rotation, width) that cover the 64 bits."""
    cuts = [round(i * 64 / (budget + 1)) for i in range(budget + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _rotate(x: np.ndarray, by: int) -> np.ndarray:
    return x if not by else (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def trie_join(values: np.ndarray, groups: np.ndarray, sides: np.ndarray, budget: int, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Positions of linked pairs within each group, by walking pairs of trie nodes.

    Rows are sorted by (group, side, value), values are distinct within a group.
    A node of the trie is a range of the sorted rows. Groups whose rows are all
    of one side are joined with themselves, others one side with the other.
    Only the first ``bits`` bits of the values are used.
    """
    n = len(values)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
    lo, hi = new, np.append(new[1:], n)
    ones = np.concatenate([[0], np.cumsum(sides != 0)])
    mid = hi - (ones[hi] - ones[lo])
    split = (mid > lo) & (mid < hi)
    a_lo, a_hi = lo, np.where(split, mid, hi)
    b_lo, b_hi = np.where(split, mid, lo), hi
    left = np.full(len(lo), budget)
    for depth in range(bits):
        bit = (values >> np.uint64(63 - depth)) & np.uint64(1)
        count = np.concatenate([[0], np.cumsum(bit.astype(np.int64))])
        am = a_hi - (count[a_hi] - count[a_lo])
        bm = b_hi - (count[b_hi] - count[b_lo])
        own = a_lo == b_lo
        parts = []
        for x_lo, x_hi, y_lo, y_hi, cost, use in (
            (a_lo, am, b_lo, bm, 0, True), (am, a_hi, bm, b_hi, 0, True),
            (a_lo, am, bm, b_hi, 1, True), (am, a_hi, b_lo, bm, 1, ~own),
        ):
            ok = (x_hi > x_lo) & (y_hi > y_lo) & (left >= cost) & use
            ok &= ~((x_lo == y_lo) & (x_hi - x_lo < 2))  # a single value has no partner in its own node
            parts.append((x_lo[ok], x_hi[ok], y_lo[ok], y_hi[ok], left[ok] - cost))
        a_lo, a_hi, b_lo, b_hi, left = (np.concatenate(p) for p in zip(*parts))
        if not len(a_lo):
            break
    return a_lo, b_lo


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest position that each of ``n`` positions reaches over the pairs."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        if (root == before).all():
            break
    return root


def links(distinct: DataFrame, cfg: SimHashConfig = SimHashConfig()) -> DataFrame:
    """Edges ``u, v`` between distinct fingerprints whose components are those of all links."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            for k, (by, width) in enumerate(_fields(cfg.budget)):
                turned = _rotate(fp, by)
                yield pa.RecordBatch.from_pydict({
                    "field": np.full(len(fp), k, np.int32), "root": (turned >> np.uint64(64 - width)).astype(np.int64),
                    "path": np.zeros(len(fp), np.int64), "side": np.zeros(len(fp), np.int32),
                    "value": (turned << np.uint64(width)).view(np.int64), "used": np.full(len(fp), width, np.int32),
                    "cost": np.zeros(len(fp), np.int32), "fp": fp.view(np.int64),
                })

    schema = "field int, root long, path long, side int, value long, used int, cost int, fp long"
    node = ["field", "root", "path", "used", "cost"]
    rows = distinct.mapInArrow(place, schema)
    edges: list[DataFrame] = []
    while True:
        sizes = written(rows.groupBy(*node).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "trie-nodes")
        large = sizes.where((F.col("n") > cfg.task_rows) & (F.col("used") + cfg.step < 64))
        held = rows.join(sizes, node)
        edges.append(held.where((F.col("n") <= cfg.task_rows) | (F.col("used") + cfg.step >= 64)).drop("n"))
        if large.isEmpty():
            break
        rows = written(_descend(held.where((F.col("n") > cfg.task_rows) & (F.col("used") + cfg.step < 64)).drop("n"), cfg, schema), "trie-split")
    found = [_joined(part, cfg) for part in edges]
    out = found[0]
    for part in found[1:]:
        out = out.union(part)
    return out.distinct()


def _descend(rows: DataFrame, cfg: SimHashConfig, schema: str) -> DataFrame:
    """Replace large nodes by the pairs of their children that are within the budget.

    A value goes to its own child and to the children within the budget of it, on
    the side that the order of the two children gives. In a pair of nodes, sides
    keep their order.
    """
    step, masks = cfg.step, np.arange(1 << cfg.step)
    weight = np.array([bin(m).count("1") for m in masks])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = {c: batch.column(c).to_numpy() for c in ("field", "root", "path", "side", "value", "used", "cost", "fp")}
            value = get["value"].view(np.uint64)
            child = (value >> np.uint64(64 - step)).astype(np.int64)
            paired = get["path"] != 0
            for mask in masks[weight <= cfg.budget]:
                ok = get["cost"] + weight[mask] <= cfg.budget
                other = child ^ mask
                side = np.where(paired, get["side"], (child > other).astype(np.int32))
                first = np.where(side == 0, child, other)
                second = np.where(side == 0, other, child)
                # The path names the pair of children below the pair named so far.
                path = get["path"] * 1000003 + (first << step | second) + 1
                path = np.where((mask == 0) & ~paired, 0, path)
                root = np.where((mask == 0) & ~paired, get["root"] << step | child, get["root"])
                yield pa.RecordBatch.from_pydict({
                    "field": get["field"][ok], "root": root[ok], "path": path[ok], "side": side[ok].astype(np.int32),
                    "value": (value << np.uint64(step)).view(np.int64)[ok], "used": (get["used"] + step)[ok].astype(np.int32),
                    "cost": (get["cost"] + weight[mask])[ok].astype(np.int32), "fp": get["fp"][ok],
                })

    return rows.mapInArrow(run, schema)


def _joined(rows: DataFrame, cfg: SimHashConfig) -> DataFrame:
    """Spanning forests of the links in every node, many nodes per numpy call."""
    node = ["field", "root", "path", "used", "cost"]

    def solve(table: pa.Table) -> pa.RecordBatch:
        keys = [table.column(c).to_numpy() for c in node]
        change = np.zeros(len(table), bool)
        change[:1] = True
        for k in keys:
            change[1:] |= k[1:] != k[:-1]
        groups, cost = np.cumsum(change), keys[4]
        value, fp = table.column("value").to_numpy().view(np.uint64), table.column("fp").to_numpy()
        side = table.column("side").to_numpy()
        order = np.lexsort((value, side, groups))
        groups, cost, value, fp, side = (x[order] for x in (groups, cost, value, fp, side))
        us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for spent in range(cfg.budget + 1):
            at = np.flatnonzero(cost == spent)
            # A node pair has both sides; a node of its own has one.
            paired = table.column("path").to_numpy()[order][at] != 0
            for kind in (False, True):
                own = at[paired == kind]
                if not len(own):
                    continue
                if kind:
                    both = np.zeros(groups[-1] + 1, np.int64)
                    np.bitwise_or.at(both, groups[own], 1 << side[own])
                    own = own[both[groups[own]] == 3]
                a, b = trie_join(value[own], groups[own], side[own] if kind else np.zeros(len(own), np.int32), cfg.budget - spent)
                root = forest(len(own), a, b)
                moved = np.flatnonzero(root != np.arange(len(own)))
                us.append(fp[own[moved]])
                vs.append(fp[own[root[moved]]])
        return pa.RecordBatch.from_pydict({"u": np.concatenate(us), "v": np.concatenate(vs)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) < 4 * cfg.task_rows:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            # Whole nodes only: the last one may go on in the next batch.
            keys = [table.column(c).to_numpy() for c in node]
            last = np.zeros(len(table), bool)
            for k in keys:
                last |= k != k[-1]
            cut = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
            if cut:
                yield solve(table.slice(0, cut))
            held = table.slice(cut).to_batches()
        if held:
            yield solve(pa.Table.from_batches(held).combine_chunks())

    dealt = rows.repartition(*node).sortWithinPartitions(*node)
    return dealt.mapInArrow(run, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the edges ``u, v``: the smallest node of its component.

    Large-star and small-star steps in turn, each written to the shared folder,
    until nothing changes. A node with very many edges is reduced to its smallest
    neighbour within each task before rows are shuffled.
    """
    current = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), "edges")
    while True:
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(small_low, "u")
            .select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v").where("u > v").distinct()
        )
        following = written(small, "edges")
        same = following.count() == current.count() and following.exceptAll(current).isEmpty()
        current = following
        if same:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(documents: DataFrame, cfg: SimHashConfig = SimHashConfig()) -> DataFrame:
    """``doc_id, _id, _tx, fp, component_id`` and ``_first`` (the row key kept of the component)."""
    rows = written(fingerprints(documents, cfg), "simhash")
    best = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("_id"), F.col("_tx"))
    distinct = written(rows.groupBy("fp").agg(F.min(best).alias("best")), "simhash-distinct")
    roots = components(links(distinct.select("fp"), cfg))
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "best"
    )
    firsts = named.groupBy("root").agg(F.min("best").alias("first"))
    named = written(named.join(firsts, "root").select("fp", "first"), "simhash-classes")
    return rows.join(named, "fp").select(
        "doc_id", "_id", "_tx", "fp", F.col("first.doc_id").alias("component_id"),
        (F.col("first._id").eqNullSafe(F.col("_id")) & (F.col("first._tx") == F.col("_tx"))).alias("_first"),
    )


def one_of_each(documents: DataFrame, cfg: SimHashConfig = SimHashConfig()) -> DataFrame:
    """The rows, unchanged, of the smallest id of each component, once each."""
    kept = near_duplicates(documents, cfg).where("_first").select(F.col("_id").alias("_ki"), F.col("_tx").alias("_kt")).distinct()
    return first_rows(documents, kept)


def first_rows(documents: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows with the keys ``_ki, _kt``, once each."""
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_row")
    keyed = documents.select(row, *row_key())
    match = (F.col("_id") == F.col("_ki")) & (F.col("_tx") == F.col("_kt"))
    return keyed.join(kept, match, "left_semi").dropDuplicates(["_id", "_tx"]).select("_row.*")
