"""Embedding and rerank models as columns.

A model plugs in by giving a column: ``column(text, role)`` for an embedder,
``column(query, title, synopsis)`` for a scorer. Model-backed versions run as
pandas UDFs over Arrow batches and load the model once per Python worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillrank.config import VECTOR_DIM
from quillrank.functions.text import build_text, tokenize

DOCUMENT = "document"
QUERY = "query"


class Embedder(Protocol):
    """Turns text into unit-length vectors of ``dim`` floats."""

    name: str
    dim: int

    def column(self, text: Column, role: str) -> Column: ...


class Scorer(Protocol):
    """Scores a passage for a query; NULL means the model could not tell."""

    name: str

    def column(self, query: Column, title: Column, synopsis: Column) -> Column: ...


class HashingEmbedder:
    """Signed feature hashing of the words of a text.

    Needs no model file: the first eight hex digits of the MD5 of a word choose
    the dimension, the ninth chooses the sign, and the counts are scaled to unit
    length.
    """

    def __init__(self, dim: int = VECTOR_DIM):
        self.name = f"hashing-{dim}"
        self.dim = dim

    def column(self, text: Column, role: str = DOCUMENT) -> Column:
        dim = self.dim

        def accumulate(words: pa.Array) -> pa.Array:
            import hashlib

            import numpy as np

            rows = len(words)
            lengths = np.diff(words.offsets.to_numpy())
            # Every distinct word of the batch is hashed once.
            coded = words.flatten().dictionary_encode()
            digits = np.fromiter(
                (int.from_bytes(hashlib.md5(w.encode()).digest()[:5], "big") >> 4
                 for w in coded.dictionary.to_pylist()),
                dtype=np.int64, count=len(coded.dictionary),
            )
            use = coded.indices.to_numpy(zero_copy_only=False)
            place = np.repeat(np.arange(rows), lengths) * dim + ((digits >> 4) % dim)[use]
            sign = np.where(digits % 2 == 0, 1.0, -1.0)[use]
            dense = np.bincount(place, weights=sign, minlength=rows * dim)
            # Few places of a vector are in use, and only these are scaled.
            cell = np.flatnonzero(dense)
            count = dense[cell]
            norm = np.sqrt(np.bincount(cell // dim, weights=count * count, minlength=rows))
            norm[norm == 0.0] = 1.0
            values = np.zeros(rows * dim, dtype=np.float32)
            values[cell] = count / norm[cell // dim]
            values = pa.array(values)
            ends = pa.array(np.arange(rows + 1, dtype=np.int32) * dim)
            return pa.ListArray.from_arrays(ends, values)

        return F.arrow_udf(accumulate, "array<float>")(tokenize(text))


class ModelEmbedder:
    """Any Python embedding model.

    ``load()`` returns a function ``(texts, role) -> list of vectors``; it runs
    once per worker and gets whole Arrow batches of texts. Vectors are scaled to
    unit length here, a zero vector stays as it is.
    """

    def __init__(self, name: str, dim: int, load: Callable[[], Callable[[list[str], str], Any]]):
        self.name = name
        self.dim = dim
        self._load = load

    def column(self, text: Column, role: str = DOCUMENT) -> Column:
        load = self._load

        def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            import numpy as np

            model = load()
            for texts in batches:
                vectors = np.asarray(list(model(texts.fillna("").tolist(), role)), dtype="float64")
                vectors = vectors.reshape(len(texts), -1)
                norm = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
                norm[norm == 0.0] = 1.0
                yield pd.Series(list((vectors / norm).astype("float32")))

        embed.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return F.pandas_udf(embed, "array<float>")(text)


class OverlapScorer:
    """Share of the distinct query words that occur in the passage."""

    name = "overlap"

    def column(self, query: Column, title: Column, synopsis: Column) -> Column:
        words = F.array_distinct(tokenize(query))
        shared = F.size(F.array_intersect(words, tokenize(build_text(title, synopsis))))
        return F.when(F.size(words) > 0, F.round(shared / F.size(words), 6)).otherwise(F.lit(0.0))


class ModelScorer:
    """Any Python cross-encoder.

    ``load()`` returns a function ``(queries, passages) -> scores``. A batch the
    model fails on gets NULL scores, so that the search keeps its fused order.
    """

    def __init__(self, name: str, load: Callable[[], Callable[[list[str], list[str]], Any]]):
        self.name = name
        self._load = load

    def column(self, query: Column, title: Column, synopsis: Column) -> Column:
        load = self._load

        def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            try:
                model = load()
            except Exception:
                model = None
            for queries, passages in batches:
                values = None
                if model is not None:
                    try:
                        values = [float(s) for s in model(queries.tolist(), passages.tolist())]
                    except Exception:
                        values = None
                yield pd.Series(values if values is not None else [None] * len(queries),
                                dtype="float64")

        score.__annotations__ = {
            "batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series],
        }
        return F.pandas_udf(score, "double")(query, build_text(title, synopsis))
