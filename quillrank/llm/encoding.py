"""BPE encoding and decoding with a byte-level vocabulary.

A text is cut at the vocabulary's added tokens, then into words by the published
pattern. The symbols of a word form a doubly linked list; a priority queue holds
the ranks of neighbouring pairs, lowest rank and leftmost first, and entries whose
symbols have changed since are skipped. Words repeat, so a task keeps the ids of
those it has seen, in a table of bounded size. Decoding concatenates the
vocabulary's byte strings.

Defined results: a null or empty text has no tokens and decodes to an empty text.
Rows are encoded one by one; repeated rows and null ids do not matter. Empty
tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quillrank.llm.tables import text_rows

WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Longer words are merged anew in every text, so that what a task keeps is bounded in bytes.
LONGEST_KEPT = 32


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in vocabulary files.

    Printable bytes stand for themselves, the others for characters from 256 on.
    """
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class BytePairCodec:
    """Encoder and decoder for one vocabulary file; built once per task."""

    def __init__(self, path: str, remembered: int = 400_000):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.symbol = [vocab[c] for c in letters]
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merge[vocab[left], vocab[right]] = (rank, vocab[left + right])
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.added.values()]) + 1
        self.strings = [b""] * size
        for token, number in vocab.items():
            self.strings[number] = bytes(byte_of[c] for c in token)
        for token, number in self.added.items():
            self.strings[number] = token.encode()
        longest_first = sorted(self.added, key=len, reverse=True)
        self.added_pattern = regex.compile("|".join(map(regex.escape, longest_first))) if longest_first else None
        self.words = regex.compile(WORD).findall
        self.remembered = remembered
        self.known: dict[str, bytes] = {}

    def merge_word(self, raw: bytes) -> list[int]:
        """Ids of one word."""
        ids = [self.symbol[b] for b in raw]
        n = len(ids)
        if n < 2:
            return ids
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        merge, queue = self.merge, []
        for i in range(n - 1):
            found = merge.get((ids[i], ids[i + 1]))
            if found:
                queue.append((found[0], i, ids[i], ids[i + 1], found[1]))
        heapq.heapify(queue)
        while queue:
            _, i, left, right, joined = heapq.heappop(queue)
            j = after[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue  # stale: one of the symbols has been merged since
            ids[i], ids[j] = joined, -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                found = merge.get((joined, ids[k]))
                if found:
                    heapq.heappush(queue, (found[0], i, joined, ids[k], found[1]))
            h = before[i]
            if h >= 0:
                found = merge.get((ids[h], joined))
                if found:
                    heapq.heappush(queue, (found[0], h, ids[h], joined, found[1]))
        return [i for i in ids if i >= 0]

    def _plain(self, text: str) -> bytes:
        words, known = self.words(text), self.known
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            pass
        if len(known) > self.remembered:
            known.clear()
        long_ones: dict[str, bytes] = {}
        for w in set(words).difference(known):
            (known if len(w) <= LONGEST_KEPT else long_ones)[w] = np.array(self.merge_word(w.encode()), "<u4").tobytes()
        return b"".join([known.get(w) or long_ones[w] for w in words])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.added_pattern is None or not self.added_pattern.search(text):
            return self._plain(text)
        out, at = [], 0
        for found in self.added_pattern.finditer(text):
            out += [self._plain(text[at : found.start()]), np.array([self.added[found.group()]], "<u4").tobytes()]
            at = found.end()
        return b"".join([*out, self._plain(text[at:])])

    def decode(self, ids: bytes) -> str:
        strings = self.strings
        return b"".join([strings[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


def vocabulary_path(name: str) -> str:
    """Place of a public vocabulary file on the machine that runs the task."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_documents(documents: DataFrame, name: str = "byte_bpe_50k.json", path: str | None = None,
                     with_ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, if asked for, ``ids`` for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = BytePairCodec(path or vocabulary_path(name))
        for batch in batches:
            if not batch.num_rows:
                continue
            counts, codes, texts, ids = [], [], [], []
            for text in batch.column("text"):
                encoded = codec.encode(text.as_py() or "")
                counts.append(len(encoded) // 4)
                codes.append(hashlib.sha256(encoded).hexdigest())
                texts.append(hashlib.sha256(codec.decode(encoded).encode()).hexdigest())
                if with_ids:
                    ids.append(np.frombuffer(encoded, "<u4").astype(np.int32))
            columns = {
                "doc_id": batch.column("doc_id"), "n_tokens": pa.array(counts, pa.int64()),
                "ids_sha256": pa.array(codes, pa.string()), "decoded_sha256": pa.array(texts, pa.string()),
            }
            if with_ids:
                columns["ids"] = pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return text_rows(documents).mapInArrow(run, schema)
