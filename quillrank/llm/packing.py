"""Packing of token sequences: dominance reduction on counts, then best fit.

Documents longer than a sequence are cut, the first piece taking what is left over.
Pieces differ only by their length, so the plan is made on the number of pieces of
each length, at most ``capacity`` rows however large the corpus is:

* Reduction (Martello and Toth). For the largest length not decided yet, look for a
  small set of pieces that dominates every other set a sequence with that piece could
  hold: any such set can be split among the members of the dominating one, so some
  best packing contains it. Such sequences are fixed, the instance shrinks, and the search
  goes on until no length has a dominating set.
* Best fit. The remaining pieces go, longest first, to the fullest open sequence they
  fit in, or to a new one.

Both work on runs of equal sequences: a pattern of lengths and how often it is used.
The first documents of a length, in the order in which tasks wrote them, take the first
places for that length. A task numbers its own pieces while it encodes; numbers become ranks
by adding the pieces of earlier tasks, so documents of one length are never sorted in one task.

Defined results: a null or empty text is its end token alone. Rows with equal ids or
texts are documents of their own. Null ids are packed like others. Very long texts are
encoded whole. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillrank.llm.encoding import WORD, BytePairCodec, byte_letters, vocabulary_path
from quillrank.llm.tables import text_rows, written


@dataclass(frozen=True)
class PackConfig:
    """``end`` is the token that closes every document."""

    capacity: int = 1024
    end: int = 2
    vocabulary: str = "byte_bpe_50k.json"


# ---------------------------------------------------------------- plan


@dataclass(frozen=True)
class Run:
    """``times`` sequences of the same content: ``(length, number)`` pairs, each length once."""

    content: tuple[tuple[int, int], ...]
    times: int


def _content(lengths: list[int]) -> tuple[tuple[int, int], ...]:
    return tuple((n, lengths.count(n)) for n in sorted(set(lengths), reverse=True))


def _others(counts: list[int], item: int) -> list[int]:
    """Counts without one piece of length ``item``."""
    rest = list(counts)
    rest[item] -= 1
    return rest


def _most_that_fit(rest: list[int], room: int, most: int = 3) -> int:
    """How many of the smallest pieces fit into ``room``, counted up to ``most``."""
    fit = 0
    for n in range(1, room + 1):
        take = min(rest[n], room // n, most - fit)
        fit, room = fit + take, room - take * n
        if fit == most or n > room:
            break
    return fit


def _best_pair(rest: list[int], room: int) -> tuple[int, int]:
    """Two lengths ``a >= b`` whose sum is the largest up to ``room``, the largest ``a`` among those."""
    found, total = (0, 0), 0
    low = [0] * (room + 1)  # the largest length up to each number that is there
    for n in range(1, room + 1):
        low[n] = n if rest[n] else low[n - 1]
    for a in range(room - 1, 0, -1):
        if not rest[a]:
            continue
        b = low[min(a, room - a)]
        if b == a and rest[a] < 2:
            b = low[a - 1]
        if b and a + b > total:
            found, total = (a, b), a + b
    return found


def dominating_set(counts: list[int], item: int, capacity: int) -> list[int] | None:
    """Pieces that belong to one sequence with a piece of length ``item`` in some best packing, or None.

    ``counts`` has the number of pieces by length.
    """
    rest, room = _others(counts, item), capacity - item
    fit = _most_that_fit(rest, room)
    if fit == 0:
        return [item]
    largest = next(n for n in range(room, 0, -1) if rest[n])
    if fit == 1 or largest == room:
        return [item, largest]
    if fit > 2:
        return None
    a, b = _best_pair(rest, room)
    if largest >= a + b:
        return [item, largest]
    if largest == a:
        # No sequence can hold two pieces longer than b beside the item.
        longer = [n for n in range(b + 1, room + 1) for _ in range(min(rest[n], 2))][:2]
        if len(longer) < 2 or sum(longer) > room:
            return [item, a, b]
    return None


def reduce_counts(counts: list[int], capacity: int) -> tuple[list[Run], list[int]]:
    """Sequences that are fixed by dominance, and the counts of what remains.

    A set stays dominating while its pieces last, so it is fixed as often as they allow.
    """
    counts, fixed = list(counts), []
    changed = True
    while changed:
        changed = False
        for item in range(capacity, 0, -1):
            while counts[item]:
                chosen = dominating_set(counts, item, capacity)
                if chosen is None:
                    break
                content = _content(chosen)
                times = min(counts[n] // k for n, k in content)
                for n, k in content:
                    counts[n] -= k * times
                fixed.append(Run(content, times))
                changed = True
    return fixed, counts


def best_fit(counts: list[int], capacity: int) -> list[Run]:
    """Best fit, longest pieces first, on runs of equal sequences.

    A piece goes where the least room remains that is enough. The next one of
    the same length finds that sequence again, as long as it has room for it.
    """
    open_runs: dict[int, list[tuple[dict[int, int], int]]] = {capacity: []}
    closed: list[Run] = []

    def place(content: dict[int, int], room: int, times: int) -> None:
        if room:
            open_runs.setdefault(room, []).append((content, times))
        else:
            closed.append(Run(tuple(sorted(content.items(), reverse=True)), times))

    for n in range(capacity, 0, -1):
        left = counts[n]
        while left:
            room = next((r for r in range(n, capacity) if open_runs.get(r)), capacity)
            content, times = open_runs[room].pop() if room < capacity else ({}, left)
            each = room // n
            full = min(times, left // each)
            if full:
                place({**content, n: each}, room - each * n, full)
                left -= full * each
            if full < times and left:
                # Fewer pieces than the next sequence of the run could take.
                place({**content, n: left}, room - left * n, 1)
                full, left = full + 1, 0
            if room < capacity and full < times:
                open_runs[room].append((content, times - full))
    for runs in open_runs.values():
        closed += [Run(tuple(sorted(content.items(), reverse=True)), times) for content, times in runs]
    return closed


def plan_runs(counts: list[int], capacity: int) -> list[Run]:
    """All sequences for the given numbers of pieces by length (index 0 is not used)."""
    fixed, rest = reduce_counts(counts, capacity)
    return fixed + best_fit(rest, capacity)


def places(runs: list[Run], capacity: int) -> dict[str, np.ndarray]:
    """Where the pieces of each length go: one row for each length of a run, by ``key``.

    ``key`` is the length and the rank of the first piece there; ``each`` pieces of the
    length stand one after the other from ``offset`` in every sequence from ``sequence`` on.
    """
    used, rows, sequence = [0] * (capacity + 1), [], 0
    for run in runs:
        offset = 0
        for n, each in run.content:
            rows.append((n, used[n], sequence, each, offset))
            used[n] += each * run.times
            offset += n * each
        sequence += run.times
    table = np.array(sorted(rows), np.int64).reshape(len(rows), 5)
    return {"key": table[:, 0] << 48 | table[:, 1], **dict(zip(("rank", "sequence", "each", "offset"), table.T[1:]))}


# ---------------------------------------------------------------- pieces


@lru_cache(maxsize=2)
def _encoder(path: str) -> tiktoken.Encoding:
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    byte_of = {c: b for b, c in enumerate(byte_letters())}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in token): number for token, number in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("packing", pat_str=WORD, mergeable_ranks=ranks, special_tokens=special)


@lru_cache(maxsize=2)
def _codec(path: str) -> BytePairCodec:
    return BytePairCodec(path)


def token_ids(text: str, path: str) -> np.ndarray:
    """Ids of a whole text. Texts that the fast splitter refuses, as runs of a million blanks, take the slow one."""
    try:
        return _encoder(path).encode_to_numpy(text, allowed_special="all").astype("<u4")
    except ValueError:
        return np.frombuffer(_codec(path).encode(text), "<u4")


def cut_lengths(total: int, capacity: int) -> tuple[int, int]:
    """Length of the first piece, and number of pieces."""
    number = -(-total // capacity)
    return total - (number - 1) * capacity, number


def pieces(documents: DataFrame, cfg: PackConfig = PackConfig(), path: str | None = None) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, _task, _number``: every piece, numbered within task and length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = path or vocabulary_path(cfg.vocabulary)
        numbers = [0] * (cfg.capacity + 1)
        end = np.array([cfg.end], "<u4")
        for batch in batches:
            rows: list[tuple[int, int, int, int, int, int]] = []
            for at, text in enumerate(batch.column("text")):
                ids = np.append(token_ids(text.as_py() or "", file), end)
                length, number = cut_lengths(len(ids), cfg.capacity)
                start = 0
                for piece in range(number):
                    code = zlib.crc32(ids[start : start + length].tobytes())
                    rows.append((at, piece, start, length, code, numbers[length]))
                    numbers[length] += 1
                    start, length = start + length, cfg.capacity
            if rows:
                table = np.array(rows, np.int64)
                owner = pa.array(table[:, 0])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(owner), pa.array(table[:, 1].astype(np.int32)),
                     *(pa.array(table[:, i]) for i in (2, 3, 4)), batch.column("_task").take(owner), pa.array(table[:, 5])],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "_task", "_number"])

    rows = text_rows(documents).withColumn("_task", F.spark_partition_id())
    return rows.mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, _task int, _number long")


def pack_documents(documents: DataFrame, cfg: PackConfig = PackConfig(), path: str | None = None) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for every piece of every row."""
    rows = written(pieces(documents, cfg, path), "pieces")
    counted = written(rows.groupBy("length", "_task").agg(F.count(F.lit(1)).alias("_n")), "piece-counts")
    # At most one row for each possible length.
    counts = [0] * (cfg.capacity + 1)
    for row in counted.groupBy("length").agg(F.sum("_n").alias("n")).collect():
        counts[row["length"]] = row["n"]
    table = places(plan_runs(counts, cfg.capacity), cfg.capacity)

    earlier = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select("length", "_task", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_first"))
    ranked = rows.join(starts, ["length", "_task"]).withColumn("_rank", F.col("_first") + F.col("_number"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            at = np.searchsorted(table["key"], length << 48 | rank, "right") - 1
            inside, each = rank - table["rank"][at], table["each"][at]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(table["sequence"][at] + inside // each),
                 pa.array(table["offset"][at] + inside % each * length)], [*kept, "sequence_id", "offset"])

    kept = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return ranked.select(*kept, "_rank").mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
