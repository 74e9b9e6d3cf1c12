"""Suffix-array dedup: a logarithmic family of sorted suffix levels over a corpus.

Only matches of at least ``length`` bytes matter, so suffixes are ordered by the
fingerprint of their first ``length`` bytes instead of by all their bytes, and
the arrays are sparse. The windows of ``length`` bytes of a text are cut into
runs that share the smallest hash among their ``seed`` -byte strings; equal windows
have equal smallest hashes, wherever they stand. A run is one entry of a suffix
array, sorted by that hash (its anchor) and the fingerprint of its content.

Documents come in batches. Each batch gets its suffix array, is merge-scanned
against the levels that exist, and becomes a level itself; two levels of equal
rank are merged into one of the next rank, so there are never more levels than
the logarithm of the number of batches. A scan looks up the anchors of the new batch
alone and returns the entries of those that occur twice, its own and those of the
levels; what no scan returns is finished: none of its windows repeats. Runs whose
content occurs twice are finished as well: all of their windows repeat. The rest
is compared window by window, in fingerprint order, among the runs of its anchor.
A family can be taken up again later with the folders of its levels.
Anchors with very many different contents are compared with one row per window
instead, spread over all tasks by the window.

Defined results: a null text is empty. Rows with the same id and text are copies
of each other, so a text of at least ``length`` bytes that is repeated as a row
loses all bytes. A null id is an id of its own. Texts shorter than ``length`` keep
all bytes. Empty tables give no rows. Extra columns are ignored, or kept by
``without_repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.llm.blocks import Block, blocks, mix
from quillrank.llm.tables import row_key, written
from quillrank.sources.workspace import discard, store

_KEYS = ["_id", "_tx"]


@dataclass(frozen=True)
class RepeatConfig:
    """``length``: bytes of a repeated string. ``batches``: parts that the documents arrive in.

    ``run_windows`` is the longest run, ``group_rows`` the number of different
    contents from which an anchor's windows are spread over all tasks.
    """

    length: int = 400
    seed: int = 64
    batches: int = 4
    run_windows: int = 2048
    group_rows: int = 2000


def _sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every ``width`` neighbours, from minima to both sides of block edges."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    grid = padded.reshape(-1, width)
    onward = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], onward[width - 1 : n])


def text_runs(text: np.ndarray, cfg: RepeatConfig) -> tuple[np.ndarray, ...]:
    """Runs of one text: anchor, content fingerprint, first window, windows, and whether to look inside.

    A run whose anchor stands in two places of the text may hold equal windows itself.
    """
    block = Block(0, np.array([0, len(text)]), text)
    width = cfg.length - cfg.seed + 1
    at = np.arange(len(text) - cfg.seed + 1)
    hashes = block.hashes(at, at + cfg.seed)
    least = _sliding_minimum(hashes, width)
    change = np.concatenate([[True], least[1:] != least[:-1]])
    starts = np.flatnonzero(change)
    sizes = np.diff(np.append(starts, len(least)))
    if sizes.max() > cfg.run_windows:
        pieces = -(-sizes // cfg.run_windows)
        within = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        ends = np.repeat(starts + sizes, pieces)
        starts = np.repeat(starts, pieces) + within * cfg.run_windows
        sizes = np.minimum(starts + cfg.run_windows, ends) - starts
    anchors = least[starts]
    contents = block.hashes(starts, starts + sizes + (cfg.length - 1))
    # Places where a hash is the smallest of some window around it: the largest
    # minimum among the windows that hold the place is the hash itself.
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    highest = ~_sliding_minimum(~padded, width)
    places = np.sort(hashes[highest == hashes])
    twice = places[1:][places[1:] == places[:-1]]
    inside = np.isin(anchors, twice)
    return anchors.view(np.int64), contents.view(np.int64), starts, sizes, inside


def sparse_suffixes(documents: DataFrame, cfg: RepeatConfig) -> DataFrame:
    """Entries of the sparse suffix arrays of all texts.

    ``_id, _tx``: the row; ``anchor, content``: the order; ``start, windows``: the
    run; ``inside``: whether windows of the run may repeat within it; ``batch``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [batch.column(k).to_numpy() for k in _KEYS]
            for block in blocks(batch.column("text")):
                found, rows = [], []
                for i in range(block.n):
                    text = block.data[block.offsets[i] : block.offsets[i + 1]]
                    if len(text) >= cfg.length:
                        found.append(text_runs(text, cfg))
                        rows.append(np.full(len(found[-1][0]), block.first + i))
                if not found:
                    continue
                row = np.concatenate(rows)
                anchor, content, start, windows, inside = (np.concatenate(x) for x in zip(*found))
                yield pa.RecordBatch.from_pydict({
                    "_id": keys[0][row], "_tx": keys[1][row], "anchor": anchor, "content": content, "start": start,
                    "windows": windows.astype(np.int32), "inside": inside,
                    "batch": (keys[1][row] % cfg.batches).astype(np.int32),
                })

    schema = "_id long, _tx long, anchor long, content long, start long, windows int, inside boolean, batch int"
    return _keyed(documents).mapInArrow(run, schema)


def _keyed(documents: DataFrame) -> DataFrame:
    return documents.select(*row_key(), F.col("text").cast("string").alias("text"))


class SuffixFamily:
    """Levels of sorted suffix entries in the shared folder.

    ``levels`` are the ranks and folders of the levels, also of an earlier session.
    """

    def __init__(self, spark: SparkSession, levels: list[tuple[int, str]] | None = None):
        self.spark = spark
        self.levels = list(levels or [])

    def _level(self, path: str) -> DataFrame:
        return self.spark.read.schema(_LEVEL).parquet(path)

    def add(self, entries: DataFrame) -> DataFrame:
        """Sort a batch into a suffix array, scan it against the levels, and let it become one.

        Returns what the scan has found, ``anchor, content, n, inside, windows``: the entries,
        old and new, of anchors of the batch that occur twice; ``n`` counts up to the batch.
        """
        new = store(_sorted(entries.withColumn("n", F.lit(1).cast("long"))), "suffix-level")
        array = new.df
        # A batch by itself, then its anchors in each level.
        hits = array.groupBy("anchor").agg(F.sum("n").alias("n"), F.max("inside").alias("inside")).where(
            "n > 1 or inside").select("anchor")
        heads, all_rows = array.select("anchor").distinct(), array
        for _, path in self.levels:
            level = self._level(path)
            hits = hits.union(heads.join(level, "anchor", "left_semi"))
            all_rows = all_rows.union(level)
        hits = written(hits.distinct(), "suffix-hits")
        found = written(_summed(all_rows.join(hits, "anchor", "left_semi")), "suffix-matches")
        self.levels.append((0, new.path))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (rank, last), (_, other) = self.levels.pop(), self.levels.pop()
            merged = store(_sorted(self._level(last).union(self._level(other))), "suffix-level")
            self.levels.append((rank + 1, merged.path))
            discard(self.spark, last, other)
        return found


_LEVEL = "anchor long, content long, n long, inside boolean, windows int"


def _summed(entries: DataFrame) -> DataFrame:
    """One entry for each content of an anchor."""
    return entries.groupBy("anchor", "content").agg(
        F.sum("n").alias("n"), F.max("inside").alias("inside"), F.max("windows").alias("windows"))


def _sorted(entries: DataFrame) -> DataFrame:
    """A level: entries in order, dealt over tasks by anchor and content."""
    return _summed(entries).sortWithinPartitions("anchor", "content")


def matched_entries(found: list[DataFrame]) -> DataFrame:
    """``anchor, content, n, inside, windows, contents`` of all scans, as the last scan of an anchor has them.

    ``contents`` is the number of different contents of the anchor. A later scan has
    counted what the earlier ones had, so the largest ``n`` is that of all batches.
    """
    every = reduce(DataFrame.union, found)
    entries = written(every.groupBy("anchor", "content").agg(
        F.max("n").alias("n"), F.max("inside").alias("inside"), F.max("windows").alias("windows")), "suffix-entries")
    return entries.join(entries.groupBy("anchor").agg(F.count(F.lit(1)).alias("contents")), "anchor")


def _pack(documents: DataFrame) -> DataFrame:
    """Row key and compressed text, so that moving texts moves less than half of their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary()).fill_null(b"")
            yield pa.RecordBatch.from_pydict({
                **{k: batch.column(k) for k in _KEYS},
                "packed": pa.array([press(x.as_buffer()) for x in texts], pa.binary()),
            })

    return _keyed(documents).mapInArrow(run, "_id long, _tx long, packed binary")


def _contents(documents: DataFrame, wanted: DataFrame, cfg: RepeatConfig) -> DataFrame:
    """``anchor, content, bytes, many``: the bytes of one run of each wanted content."""
    chosen = wanted.groupBy(*_KEYS).agg(F.collect_list(F.struct("anchor", "content", "start", "windows", "many")).alias("runs"))
    rows = _pack(documents).join(chosen, _KEYS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for packed, runs in zip(batch.column("packed"), batch.column("runs")):
                text, parts = unpack(packed.as_buffer()), runs.as_py()
                yield pa.RecordBatch.from_pydict({
                    "anchor": pa.array([r["anchor"] for r in parts], pa.int64()),
                    "content": pa.array([r["content"] for r in parts], pa.int64()),
                    "bytes": pa.array([text[r["start"] : r["start"] + r["windows"] + cfg.length - 1] for r in parts], pa.binary()),
                    "many": pa.array([r["many"] for r in parts], pa.bool_()),
                })

    return rows.mapInArrow(run, "anchor long, content long, bytes binary, many boolean")


def _windows(data: pa.Array, cfg: RepeatConfig, limit: int = 1 << 19):
    """Fingerprints of all windows of the given byte strings: run number, offset, fingerprint."""
    for block in blocks(data, limit):
        count = np.maximum(np.diff(block.offsets) - cfg.length + 1, 0)
        run = np.repeat(np.arange(block.n), count)
        offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        at = block.offsets[run] + offset
        yield block.first + run, offset, block.hashes(at, at + cfg.length)


def _intervals(rows: pa.Table, run: np.ndarray, offset: np.ndarray) -> pa.RecordBatch:
    """``anchor, content, first, last`` for the sorted offsets of repeated windows."""
    cut = np.concatenate([[True], (run[1:] != run[:-1]) | (offset[1:] != offset[:-1] + 1)])
    begin = np.flatnonzero(cut)
    stop = np.append(begin[1:], len(run)) - 1
    return pa.RecordBatch.from_pydict({
        "anchor": rows.column("anchor").to_numpy()[run[begin]], "content": rows.column("content").to_numpy()[run[begin]],
        "first": offset[begin].astype(np.int32), "last": offset[stop].astype(np.int32),
    })


def _compare(contents: DataFrame, cfg: RepeatConfig) -> DataFrame:
    """``anchor, content, first, last``: windows that occur twice among the runs of their anchor."""
    schema = "anchor long, content long, first int, last int"

    def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        anchor = table.column("anchor").to_numpy().view(np.uint64)
        parts = list(_windows(table.column("bytes").chunk(0), cfg))
        run, offset, prints = (np.concatenate(x) for x in zip(*parts))
        prints = mix(prints + anchor[run])
        order = np.argsort(prints)
        same = prints[order[1:]] == prints[order[:-1]]
        twice = np.zeros(len(prints), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        at = np.flatnonzero(twice)
        if len(at):
            yield _intervals(table, run[at], offset[at])

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            # Cut the stream into pieces of bounded bytes, at changes of the anchor.
            for piece in (batch.slice(i, 2000) for i in range(0, batch.num_rows, 2000)):
                held.append(piece)
                size += piece.nbytes
                if size < 2 << 20:
                    continue
                table = pa.Table.from_batches(held)
                anchor = table.column("anchor").to_numpy()
                last = np.flatnonzero(anchor != anchor[-1])
                cut = int(last[-1]) + 1 if len(last) else 0
                if cut:
                    yield from solve(table.slice(0, cut))
                held = table.slice(cut).to_batches()
                size = sum(b.nbytes for b in held) if cut else size
        if held:
            yield from solve(pa.Table.from_batches(held))

    few = contents.where("not many").select("anchor", "content", "bytes")
    local = few.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(within, schema)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            anchor, content = batch.column("anchor").to_numpy(), batch.column("content").to_numpy()
            for run, offset, prints in _windows(batch.column("bytes"), cfg):
                yield pa.RecordBatch.from_pydict({
                    "anchor": anchor[run], "content": content[run], "offset": offset.astype(np.int32), "print": prints.view(np.int64),
                })

    rows = contents.where("many").mapInArrow(spread, "anchor long, content long, offset int, print long")
    twice = rows.groupBy("anchor", "print").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    wide = rows.join(twice, ["anchor", "print"]).select("anchor", "content", F.col("offset").alias("first"), F.col("offset").alias("last"))
    return local.union(wide)


def repeated_spans(documents: DataFrame, cfg: RepeatConfig = RepeatConfig()) -> DataFrame:
    """``_id, _tx, spans``: byte spans of texts covered by repeated strings, not yet united."""
    entries = written(sparse_suffixes(documents, cfg), "suffix-runs")
    family = SuffixFamily(documents.sparkSession)
    found = [family.add(entries.where(F.col("batch") == F.lit(number))) for number in range(cfg.batches)]
    repeated = written(matched_entries(found), "suffix-repeated")

    # One run stands for each content that has to be looked into.
    open_ = repeated.where("contents > 1 or (inside and n = 1)")
    keyed = entries.select(*_KEYS, "anchor", "content", "start", "windows")
    one = F.min(F.struct(*_KEYS, "start", "windows")).alias("one")
    wanted = (
        keyed.join(open_.select("anchor", "content", "contents"), ["anchor", "content"])
        .groupBy("anchor", "content").agg(one, (F.max("contents") > cfg.group_rows).alias("many"))
        .select("anchor", "content", "one.*", "many")
    )
    compared = _compare(written(_contents(documents, wanted, cfg), "suffix-contents"), cfg)

    # Every window of a content that occurs twice repeats; of others, those found to.
    whole = repeated.where("n > 1").select("anchor", "content", F.lit(0).alias("first"), (F.col("windows") - 1).alias("last"))
    single = compared.join(repeated.where("n = 1").select("anchor", "content"), ["anchor", "content"])
    verdict = whole.union(single.select("anchor", "content", "first", "last"))
    spans = keyed.join(verdict, ["anchor", "content"]).select(
        *_KEYS, (F.col("start") + F.col("first")).alias("a"), (F.col("start") + F.col("last") + cfg.length).alias("b")
    )
    return spans.groupBy(*_KEYS).agg(F.collect_set(F.struct("a", "b")).alias("spans"))


def _united(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _kept(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for span in spans for x in span), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))


def cut_repeats(documents: DataFrame, cfg: RepeatConfig = RepeatConfig()) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row.

    Texts without a repeated string are hashed where they are read; only the
    others are brought together with their spans.
    """
    spans = written(repeated_spans(documents, cfg), "suffix-spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            removed, count, digest = [], [], []
            for packed, found in zip(batch.column("packed"), batch.column("spans")):
                text, parts = unpack(packed.as_buffer()), _united(found.as_py())
                removed.append(sum(b - a for a, b in parts))
                count.append(len(parts))
                digest.append(hashlib.sha256(_kept(text, parts)).hexdigest())
            yield pa.RecordBatch.from_pydict({
                **{k: batch.column(k) for k in _KEYS}, "n_removed": pa.array(removed, pa.int64()),
                "n_spans": pa.array(count, pa.int64()), "cut_sha256": pa.array(digest, pa.string()),
            })

    cut = _pack(documents).join(spans, _KEYS).mapInArrow(
        run, "_id long, _tx long, n_removed long, n_spans long, cut_sha256 string"
    ).dropDuplicates(_KEYS)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), *row_key(), F.octet_length(text).cast("long").alias("n_bytes"),
        F.sha2(text.cast("binary"), 256).alias("_sha"),
    )
    return rows.join(cut, _KEYS, "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("cut_sha256", "_sha").alias("kept_sha256"),
    )


def without_repeats(documents: DataFrame, cfg: RepeatConfig = RepeatConfig()) -> DataFrame:
    """The rows with repeated bytes cut out of their texts; other columns as they are.

    ``n_chars``, if there, becomes the new length. Characters that a cut has split
    go as well. A text of which no more than white space is left goes with its row;
    texts that had nothing else before stay.
    """
    spans = written(repeated_spans(documents, cfg), "suffix-spans")
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_row")
    rows = documents.select(row, *row_key(), F.col("text").cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, found in zip(batch.column("_text").to_pylist(), batch.column("spans").to_pylist()):
                texts.append(_kept(text.encode(), _united(found)).decode("utf-8", "ignore") if found else text)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), pa.array(texts, pa.string()), batch.column("spans")], ["_row", "_cut", "spans"]
            )

    joined = rows.join(spans, _KEYS, "left").select("_row", "_text", "spans")
    cut = joined.mapInArrow(run, joined.withColumnRenamed("_text", "_cut").schema)
    cut = cut.where(F.col("spans").isNull() | F.col("_cut").rlike(r"[^\x20\x09-\x0D]"))
    out = []
    for name, kind in documents.dtypes:
        column = F.col("_row").getField(name)
        if name == "text":
            column = F.col("_cut")
        elif name == "n_chars":
            column = F.when(F.col("spans").isNull(), column).otherwise(F.length("_cut")).cast(kind)
        out.append(column.alias(name))
    return cut.select(*out)
