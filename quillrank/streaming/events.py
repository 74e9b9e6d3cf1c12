"""Decoding, checking and deduplicating document events.

The functions work on batch and streaming DataFrames alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank import schema
from quillrank.config import ROUTING_KEY
from quillrank.functions.text import first_non_empty

MALFORMED = "malformed"
NO_ID = "no id"
NO_TITLE = "no title"


def read_event_files(spark: SparkSession, path: str, *, max_files: int = 10, fmt: str = "json") -> DataFrame:
    """Event envelopes that arrive as files; ``max_files`` limits one micro-batch."""
    return (
        spark.readStream.schema(schema.EVENT_ENVELOPE).option("maxFilesPerTrigger", max_files)
        .format(fmt).load(path)
    )


def read_event_topic(spark: SparkSession, servers: str, topic: str, *, max_offsets: int = 10_000) -> DataFrame:
    """Event envelopes from a Kafka topic; needs the Kafka connector jar.

    The record key is the routing key. Offsets repeat over partitions, so an event
    is known by both: the partition in the high bits, the offset in the low 44.
    """
    records = (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic).option("maxOffsetsPerTrigger", max_offsets).load()
    )
    return records.select(
        topic_event_id(F.col("partition"), F.col("offset")).alias("event_id"), F.col("timestamp").alias("ts"),
        F.col("key").cast("string").alias("routing_key"), F.col("value").cast("string").alias("body"),
    )


def topic_event_id(partition: Column, offset: Column) -> Column:
    """One number for a record of a topic, in the order of offsets within a partition."""
    return F.shiftleft(partition.cast("long"), 44).bitwiseOR(offset.cast("long"))


def routed(events: DataFrame, routing_key: str = ROUTING_KEY) -> DataFrame:
    return events.where(F.col("routing_key") == routing_key)


def decode(events: DataFrame) -> DataFrame:
    """Add the fields of the JSON body and the reason for rejection, if any."""
    body = F.from_json("body", schema.EVENT_BODY, {"columnNameOfCorruptRecord": "corrupt"})
    parsed = events.withColumn("_body", body)
    field: Column = F.col("_body")
    return parsed.select(
        "event_id", "ts", "body",
        first_non_empty(field["id"], field["bookId"]).alias("doc_id"),
        F.coalesce(field["title"], F.lit("")).alias("title"),
        F.coalesce(field["synopsis"], F.lit("")).alias("synopsis"),
        F.coalesce(field["bookPicture"], F.lit("")).alias("book_picture"),
        F.when(field.isNull() | field["corrupt"].isNotNull(), MALFORMED)
        .when(first_non_empty(field["id"], field["bookId"]) == "", NO_ID)
        .when(F.coalesce(field["title"], F.lit("")) == "", NO_TITLE)
        .alias("reason"),
    )


def accepted(decoded: DataFrame) -> DataFrame:
    """Valid events as documents; lists and publisher are unknown to an event."""
    nothing = F.array().cast("array<string>")
    return decoded.where(F.col("reason").isNull()).select(
        "event_id", "ts", "doc_id", "title", "synopsis",
        nothing.alias("authors"), nothing.alias("genres"), F.lit("").alias("publisher"), "book_picture",
    )


def rejected(decoded: DataFrame) -> DataFrame:
    """Invalid events with the reason; they are kept aside and never retried."""
    return decoded.where(F.col("reason").isNotNull()).select("event_id", "ts", "reason", "body")


def without_redelivered(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Stream in which an ``event_id`` that is repeated within ``delay`` is let through once.

    ``delay`` counts from the arrival of an event, so no event is too late by its own
    time, and ids are forgotten after it. A repeat that comes later passes; the
    upsert makes it harmless.
    """
    arriving = events.withColumn("_arrived", F.current_timestamp())
    return arriving.withWatermark("_arrived", delay).dropDuplicatesWithinWatermark(["event_id"]).drop("_arrived")


def latest_by_key(documents: DataFrame) -> DataFrame:
    """Running newest version of every document, for update mode."""
    columns = [c for c in documents.columns if c != "doc_id"]
    newest = F.max_by(F.struct(*columns), F.struct("ts", "event_id"))
    return documents.groupBy("doc_id").agg(newest.alias("_row")).select("doc_id", "_row.*")
