"""Texts of Arrow batches as blocks of bytes, and vectorised hashes of their parts.

All functions work on whole blocks with numpy, without a Python step for each
word. A block holds whole texts, about ``BLOCK_BYTES`` of them; a longer text is
a block of its own, so memory follows the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 19

_RANDOM = np.random.RandomState(20240501)
_BYTE = _RANDOM.randint(0, 2**63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _geometric(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, at least ``n`` of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 2 * BLOCK_BYTES)
        _powers[:] = [_geometric(_BASE, size), _geometric(_INVERSE, size)]
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def combine(*parts: np.ndarray) -> np.ndarray:
    """Hash of a sequence of hashes, in order."""
    out = parts[0]
    for part in parts[1:]:
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + part)
    return out


@dataclass
class Block:
    """Texts ``first`` up to ``first + n`` of a batch: their bytes end to end."""

    first: int
    offsets: np.ndarray
    data: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1

    @cached_property
    def prefix(self) -> np.ndarray:
        """Running polynomial hash; the hash of a span is a difference of two entries."""
        out = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_BYTE[self.data] * powers(len(self.data) + 1)[0][: len(self.data)], out=out[1:])
        return out

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of spans; equal bytes give equal hashes wherever they stand."""
        return mix((self.prefix[ends] - self.prefix[starts]) * powers(len(self.data) + 1)[1][starts])

    def owner(self, positions: np.ndarray) -> np.ndarray:
        """Number within the block of the text that holds each byte position."""
        return np.searchsorted(self.offsets, positions, "right") - 1

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a value of each byte over each text."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return np.diff(total[self.offsets])

    def tokens(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs of flagged bytes within texts: starts, ends, first run of each text."""
        edges = self.offsets[:-1][np.diff(self.offsets) > 0]
        before = np.zeros(len(inside), bool)
        before[1:] = inside[:-1]
        before[edges] = False
        starts = np.flatnonzero(inside & ~before)
        after = np.zeros(len(inside), bool)
        after[:-1] = inside[1:]
        after[edges[1:] - 1] = False
        ends = np.flatnonzero(inside & ~after) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut a string or binary array into blocks; a null is an empty text."""
    if not len(texts):
        return
    wide = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    raw = wide.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(wide):
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), len(wide))
        part = offsets[first : last + 1]
        yield Block(first, part - part[0], data[part[0] : part[-1]])
        first = last


def over_blocks(batch: pa.RecordBatch, column: str, work) -> list[np.ndarray]:
    """Apply ``work(block) -> arrays with one value per text`` to a batch, joined in order."""
    parts = [work(block) for block in blocks(batch.column(column))]
    if not parts:
        return []
    return [np.concatenate(arrays) for arrays in zip(*parts)]
