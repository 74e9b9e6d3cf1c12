"""Token counts by dynamic programming over the prefixes of a text.

The vocabulary is a byte-pair model of pieces with a rank each, white space written
as a mark. No piece has a mark after another character, so merges never cross the
start of a run of marks, and a text falls into units that are encoded alone. Within
a unit, the encoding of every prefix ends in exactly one piece: the one that spells
the end of the prefix, follows on the encoding of the rest, and would be left as it
is beside the last piece of that rest. Going through the prefixes in order gives
the exact token count of each. Counts of units that a task has seen are kept, in a
table of bounded size; running sums over the units give the counts of a whole
text's prefixes. Truncation to a budget is a search in these, without encoding.

Defined results: a null or empty text has no tokens. Rows are counted one by one;
repeated rows and null ids do not matter. Empty tables give no rows. Extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.llm.blocks import BLOCK_BYTES, Block, blocks
from quillrank.llm.encoding import vocabulary_path
from quillrank.llm.tables import text_rows

MARK = "▁"
#: Longer units are counted anew wherever they occur, so that what a task keeps is bounded in bytes.
LONGEST_KEPT = 64


class PrefixCounter:
    """Exact token counts of all prefixes, for one piece model; built once per task."""

    def __init__(self, path: str, remembered: int = 500_000):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        usable = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.rank = {model.id_to_piece(i): -model.get_score(i) for i in usable}
        if any(MARK in piece.lstrip(MARK) for piece in self.rank):
            raise ValueError("a piece has a mark after another character; units are not independent")
        # Pieces that their own merges lead to, and everything that such a piece ends with.
        self.standing = {piece for piece in self.rank if self._merged(piece) == [piece]}
        self.tails = {piece[i:] for piece in self.standing for i in range(len(piece))}
        self.remembered = remembered
        self.known: dict[bytes, int] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    def _merged(self, text: str) -> list[str]:
        """Pieces of a short text by merging the best pair until none is left."""
        parts = list(text)
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: (self.rank.get(parts[i] + parts[i + 1], np.inf), i))
            if parts[best] + parts[best + 1] not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def _follows(self, left: str, right: str) -> bool:
        if len(self.pairs) > self.remembered:
            self.pairs.clear()
        found = self.pairs[left, right] = self._merged(left + right) == [left, right]
        return found

    def _extend(self, unit: str, counts: list[int], last: list[str], begin: list[int]) -> None:
        """Go on from the prefixes that the lists hold to those of the whole unit.

        By number of characters: token count, last piece, and the end of the last
        character outside the vocabulary, which is written byte by byte and merges
        with nothing.
        """
        standing, tails, pairs = self.standing, self.tails, self.pairs
        first = begin[-1]
        for end in range(len(counts), len(unit) + 1):
            ending, start = [], end - 1
            while start >= first and (tail := unit[start:end]) in tails:
                if tail in standing:
                    ending.append(start)
                start -= 1
            if not ending:
                counts.append(counts[-1] + len(unit[end - 1].encode()))
                last.append("")
                first = end
            for start in reversed(ending):
                piece = unit[start:end]
                fits = start == first or pairs.get((last[start], piece))
                if fits is None:
                    fits = self._follows(last[start], piece)
                if fits:
                    counts.append(counts[start] + 1)
                    last.append(piece)
                    break
            begin.append(first)

    def prefixes(self, unit: str) -> list[int]:
        """Token count of each prefix of a unit, by its number of characters."""
        counts, last, begin = [0], [""], [0]
        self._extend(unit, counts, last, begin)
        return counts

    def unit_counts(self, units: list[bytes]) -> np.ndarray:
        """Token counts of whole units. New ones are taken in order, so that each goes on
        from the prefix it shares with the one before."""
        known = self.known
        if len(known) > self.remembered:
            known.clear()
        long_ones: dict[bytes, int] = {}
        before, counts, last, begin = "", [0], [""], [0]
        for raw in sorted(u for u in units if u not in known):
            unit = raw.decode().replace(" ", MARK)
            shared = 0
            for a, b in zip(unit, before):
                if a != b:
                    break
                shared += 1
            del counts[shared + 1 :], last[shared + 1 :], begin[shared + 1 :]
            self._extend(unit, counts, last, begin)
            (known if len(raw) <= LONGEST_KEPT else long_ones)[raw] = counts[-1]
            before = unit
        return np.array([known[u] if u in known else long_ones[u] for u in units], np.int64)

    def running(self, block: Block) -> tuple[Block, np.ndarray, np.ndarray, np.ndarray]:
        """Units of a block and the running token count before each.

        The block is given with the one space that the model puts before every
        text that is not empty. Returns it, the units' starts, the first unit of
        each text, and the running counts with the total at the end.
        """
        blank = block.data == 32
        starts = blank.copy()
        starts[1:] &= ~blank[:-1]
        starts[block.offsets[:-1][np.diff(block.offsets) > 0]] = True
        at = np.flatnonzero(starts)
        stop = np.append(at[1:], len(block.data))
        prints, first, which = np.unique(block.hashes(at, stop), return_index=True, return_inverse=True)
        text = block.data.tobytes()
        counts = self.unit_counts([text[a:b] for a, b in zip(at[first].tolist(), stop[first].tolist())])
        total = np.concatenate([[0], np.cumsum(counts[which])])
        return block, at, np.searchsorted(at, block.offsets), total

    def fitting(self, unit: bytes, budget: int) -> int:
        """Bytes of the longest prefix of a unit that has at most ``budget`` tokens."""
        counts = self.prefixes(unit.decode().replace(" ", MARK))
        fits = [i for i, n in enumerate(counts) if n <= budget]
        return len(unit.decode()[: fits[-1]].encode())


def _spaced(block: Block) -> Block:
    """The block with one space before each text that is not empty."""
    filled = (np.diff(block.offsets) > 0).astype(np.int64)
    shift = np.concatenate([[0], np.cumsum(filled)])
    data = np.full(len(block.data) + int(shift[-1]), 32, np.uint8)
    data[np.arange(len(block.data)) + np.repeat(shift[1:], np.diff(block.offsets))] = block.data
    return Block(block.first, block.offsets + shift, data)


def count_tokens(documents: DataFrame, limit: int = 4096, name: str = "piece_bpe_32k.model",
                 path: str | None = None) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit, fit_bytes`` for every row.

    ``fit_bytes`` is the length of a prefix, in whole characters, that has at most
    ``limit`` tokens when encoded by itself: the longest one that ends in the last
    unit to begin within the limit. Marks in the text count as one byte there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PrefixCounter(path or vocabulary_path(name))
        for batch in batches:
            for block in blocks(batch.column("marked"), 4 * BLOCK_BYTES):
                spaced, at, first, total = counter.running(_spaced(block))
                n = total[first[1:]] - total[first[:-1]]
                fit = np.diff(block.offsets)
                for i in np.flatnonzero(n > limit):
                    # The last unit that begins within the budget, then a prefix of it.
                    u = int(np.searchsorted(total[first[i] : first[i + 1]], total[first[i]] + limit, "right")) - 1 + first[i]
                    end = at[u + 1] if u + 1 < len(at) else len(spaced.data)
                    unit = spaced.data[at[u] : min(end, spaced.offsets[i + 1])].tobytes()
                    more = counter.fitting(unit, int(limit - (total[u] - total[first[i]])))
                    fit[i] = at[u] + more - spaced.offsets[i] - 1
                span = slice(block.first, block.first + block.n)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id")[span], "n_bytes": batch.column("n_bytes")[span],
                    "n_tokens": n, "over_limit": n > limit, "fit_bytes": np.maximum(fit, 0),
                })

    rows = text_rows(documents).select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        # A mark in the text counts as a space.
        F.translate("text", MARK, " ").alias("marked"),
    )
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_bytes long")
