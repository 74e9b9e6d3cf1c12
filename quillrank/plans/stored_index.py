"""Keeping a search index under a name that later sessions can open.

A saved index is a folder of versions and a small table that says which of them
counts. A version is written completely before it is pointed to, so a reader
never sees half an index, and an older version stays until it is removed.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict

from pyspark.sql import DataFrame, DataFrameWriter, Row, SparkSession

from quillrank.config import RetrievalConfig
from quillrank.functions.embedders import Embedder
from quillrank.operators.dense import CellIndex
from quillrank.operators.fuzzy import KEY_PART
from quillrank.operators.lexical import LexicalIndex
from quillrank.plans.indexing import SearchIndex, rebuild
from quillrank.sources.workspace import bucket_count, newest_row, save_bucketed

_MANIFEST = "version string, number long, buckets int, embedder string, config string, counts string, centers string"
_PLAIN = ("term_stats", "field_stats")


def _table_name() -> str:
    return f"quillrank_saved_{uuid.uuid4().hex}"


def _bucketed(
    spark: SparkSession, writer: DataFrameWriter, path: str, buckets: int, sort_by: list[str] | None = None
) -> None:
    """Write bucket files by document; the table that this needs is forgotten, the files stay."""
    name = _table_name()
    save_bucketed(writer, spark, path, name, buckets, sort_by)
    spark.sql(f"DROP TABLE {name}")


def save_index(index: SearchIndex, path: str, cfg: RetrievalConfig) -> None:
    """Write the index as the newest version under ``path``.

    An index with changes is put into one part first.
    """
    spark = index.corpus.sparkSession
    if len(index.lexical.parts) > 1:
        index = rebuild(index, cfg)
    buckets = index.buckets or bucket_count(spark, cfg.index_buckets, index.corpus)
    known = _manifest(spark, path)
    number = 1 + (known["number"] if known else 0)
    version = f"{path}/version-{number}-{uuid.uuid4().hex}"
    _bucketed(spark, index.corpus.write, f"{version}/corpus", buckets, ["doc_id"])
    (postings,) = index.lexical.parts
    _bucketed(spark, postings.write.partitionBy("term_part"), f"{version}/postings", buckets)
    for name in _PLAIN:
        getattr(index.lexical, name).write.parquet(f"{version}/{name}")
    index.lexical.keys.write.partitionBy(KEY_PART).parquet(f"{version}/keys")
    if index.cells:
        index.cells.vectors.repartition("cell", "slice").write.partitionBy("cell").parquet(f"{version}/cells")
        index.cells.slices.write.parquet(f"{version}/slices")
    centers = json.dumps(index.cells.centers if index.cells else None)
    row = (version, number, buckets, index.embedder.name, json.dumps(asdict(cfg), sort_keys=True), json.dumps(index.counts), centers)
    spark.createDataFrame([row], _MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def _manifest(spark: SparkSession, path: str) -> Row | None:
    """The row of the newest version, or None where nothing was saved."""
    return newest_row(spark, f"{path}/manifest", _MANIFEST, "number")


def _opened(spark: SparkSession, path: str, buckets: int, partition: str | None) -> DataFrame:
    """Bucket files as a table, so that reading by document needs no shuffle."""
    rows = spark.read.parquet(path)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    name = _table_name()
    spark.sql(
        f"CREATE TABLE {name} ({columns}) USING parquet "
        + (f"PARTITIONED BY ({partition}) " if partition else "")
        + f"CLUSTERED BY (doc_id) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    if partition:
        spark.sql(f"MSCK REPAIR TABLE {name}")
    return spark.table(name)


def open_index(spark: SparkSession, path: str, embedder: Embedder) -> tuple[SearchIndex, RetrievalConfig]:
    """The newest version of a saved index and the settings it was built with.

    The embedder must be the one that made the vectors.
    """
    saved = _manifest(spark, path)
    if saved is None:
        raise FileNotFoundError(f"no index was saved under {path}")
    if saved["embedder"] != embedder.name:
        raise ValueError(f"the index has vectors of {saved['embedder']}, not of {embedder.name}")
    settings = json.loads(saved["config"])
    settings["keyword_fields"] = tuple(settings["keyword_fields"])
    corpus = _opened(spark, f"{saved['version']}/corpus", saved["buckets"], None)
    postings = _opened(spark, f"{saved['version']}/postings", saved["buckets"], "term_part")
    plain = {name: spark.read.parquet(f"{saved['version']}/{name}") for name in (*_PLAIN, "keys")}
    cells, centers = None, json.loads(saved["centers"] or "null")
    if centers:
        vectors = spark.read.parquet(f"{saved['version']}/cells")
        cells = CellIndex(vectors, centers, spark.read.parquet(f"{saved['version']}/slices"))
    return (
        SearchIndex(corpus, LexicalIndex((postings,), **plain), embedder, json.loads(saved["counts"]), cells,
                    saved["buckets"]),
        RetrievalConfig(**settings),
    )
