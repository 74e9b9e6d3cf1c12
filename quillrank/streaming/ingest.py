"""Streaming upsert into an append-only document log.

Every micro-batch owns one folder of the log and overwrites it when it is
replayed, so a repeated batch changes nothing. The corpus is the newest version
of every document in the log. ``compact`` writes these versions out, so that later
readers start from them and read only the batches that came after.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillrank import schema
from quillrank.functions.embedders import Embedder
from quillrank.operators.corpus import embed, latest
from quillrank.sources.workspace import newest_row
from quillrank.streaming.events import accepted, decode, rejected, routed

LOG_SCHEMA = (
    "event_id bigint, ts timestamp, doc_id string, title string, synopsis string, "
    "authors array<string>, genres array<string>, publisher string, book_picture string, "
    "vector array<float>, batch_id bigint"
)
VERSION_SCHEMA = LOG_SCHEMA.removesuffix(", batch_id bigint")
_COMPACTED = "through bigint, folder string"
REJECTED_SCHEMA = "event_id bigint, ts timestamp, reason string, body string, batch_id bigint"


def write_batch(decoded: DataFrame, batch_id: int, embedder: Embedder, path: str) -> None:
    """Store one micro-batch: the newest version per document, and the rejects."""
    decoded.persist()  # read from the source once for both
    try:
        newest = latest(accepted(decoded), "doc_id", ["ts", "event_id"])
        embed(newest, embedder).write.mode("overwrite").parquet(f"{path}/log/batch_id={batch_id}")
        rejected(decoded).write.mode("overwrite").parquet(f"{path}/rejected/batch_id={batch_id}")
    finally:
        decoded.unpersist()


def start_ingest(
    events: DataFrame, embedder: Embedder, path: str, *, routing_key: str, once: bool = False
) -> StreamingQuery:
    """Consume event envelopes into the log below ``path``.

    ``once`` processes what is there and stops. After a failure, starting again
    continues from the checkpoint below ``path``.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, batch_id, embedder, path)

    writer = (
        decode(routed(events, routing_key)).writeStream.foreachBatch(handle)
        .option("checkpointLocation", f"{path}/checkpoint")
    )
    return (writer.trigger(availableNow=True) if once else writer).start()


def finish(query: StreamingQuery) -> None:
    """Process all that the source of a running query holds now, in batches of its size, and stop."""
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG_SCHEMA).parquet(f"{path}/log")


def read_rejected(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REJECTED_SCHEMA).parquet(f"{path}/rejected")


def compact(spark: SparkSession, path: str, through: int) -> None:
    """Write the newest version of every document in the batches up to ``through``.

    These batches must be complete: ``lastProgress`` of a running query names the
    last one. The versions keep their time, so an event that arrives later than a
    newer one changes nothing. A snapshot counts once it is named in the table of
    snapshots, which happens last; readers of an older one are not disturbed. The
    log stays, for ``changes`` and patched snapshots.
    """
    base = _newest_snapshot(spark, path)
    if base is not None and base["through"] >= through:
        return
    folder = f"{path}/snapshots/through-{through}-{uuid.uuid4().hex}"
    kept = _versions(spark, path).where(F.col("batch_id") <= through).drop("batch_id")
    latest(kept, "doc_id", ["ts", "event_id"]).write.parquet(folder)
    row = spark.createDataFrame([(through, folder)], _COMPACTED)
    row.coalesce(1).write.mode("append").parquet(f"{path}/snapshots/known")


def _newest_snapshot(spark: SparkSession, path: str) -> Row | None:
    return newest_row(spark, f"{path}/snapshots/known", _COMPACTED, "through")


def _versions(spark: SparkSession, path: str) -> DataFrame:
    """All versions that can still be the newest: the last snapshot and the batches after it."""
    log = read_log(spark, path)
    base = _newest_snapshot(spark, path)
    if base is None:
        return log
    known = spark.read.schema(VERSION_SCHEMA).parquet(base["folder"])
    return log.where(F.col("batch_id") > base["through"]).unionByName(
        known.withColumn("batch_id", F.lit(base["through"])))


def snapshot(spark: SparkSession, path: str, mode: str = "replace") -> DataFrame:
    """The corpus of all micro-batches in the log.

    Patched documents need their whole history, so that mode reads the whole log.
    """
    columns = [f.name for f in schema.CORPUS]
    versions = _versions(spark, path) if mode == "replace" else read_log(spark, path)
    return latest(versions.select(*columns, "ts", "event_id"), "doc_id", ["ts", "event_id"], mode).select(columns)


def changes(spark: SparkSession, path: str, after_batch: int) -> DataFrame:
    """Current versions of the documents that batches after ``after_batch`` touched.

    Feed them to ``apply_changes`` to make new events searchable. The version is
    taken from all batches, so an event that arrived late changes nothing.
    """
    columns = [f.name for f in schema.CORPUS]
    touched = read_log(spark, path).where(F.col("batch_id") > after_batch).select("doc_id").distinct()
    versions = _versions(spark, path).join(touched, "doc_id", "left_semi").select(*columns, "ts", "event_id")
    return latest(versions, "doc_id", ["ts", "event_id"]).select(columns)


def start_latest(documents: DataFrame, path: str, *, once: bool = False) -> StreamingQuery:
    """Write the changed keys of a running ``latest_by_key`` aggregation, batch by batch."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/changes/batch_id={batch_id}")

    writer = (
        documents.writeStream.outputMode("update").foreachBatch(handle)
        .option("checkpointLocation", f"{path}/checkpoint")
    )
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_latest(spark: SparkSession, path: str, row_schema: str) -> DataFrame:
    """Keys with the value of their last change."""
    changes = spark.read.schema(f"{row_schema}, batch_id bigint").parquet(f"{path}/changes")
    return latest(changes, "doc_id", ["batch_id"]).drop("batch_id")
