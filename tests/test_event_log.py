"""The event log as a streaming source: batches of bounded size, restarts, completeness."""

import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quillrank import HashingEmbedder, schema
from quillrank.streaming import event_log, ingest


def envelopes(spark, first, last, key=None):
    """Events ``first`` to ``last`` (excluded); every third one has another routing key, every fifth none."""
    event = F.col("id")
    routing = F.lit(key) if key else F.when(event % 5 == 0, None).when(event % 3 == 0, "other").otherwise("book")
    return spark.range(first, last, 1, 3).select(
        event.alias("event_id"), F.timestamp_seconds(event).alias("ts"), routing.alias("routing_key"),
        F.to_json(F.struct((event % 40).cast("string").alias("id"), event.cast("string").alias("title"))).alias("body"),
        F.lit("x").alias("body_of_a_wider_log"),
    )


def collect_ids(stream, path, fail_at=None):
    """Run a query over the stream; returns it stopped, with the rows of its batches below ``path``."""

    def handle(batch, number):
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        if number == fail_at:
            raise ValueError("lost")

    query = stream.writeStream.foreachBatch(handle).option("checkpointLocation", f"{path}/checkpoint").start()
    ingest.finish(query)


def rows(spark, path):
    return spark.read.schema("event_id long, routing_key string, batch long").parquet(f"{path}/rows").collect()


def test_batches_are_bounded_and_whole(spark, workdir):
    for number, (first, last) in enumerate([(0, 100), (100, 100), (100, 137), (137, 400)]):
        event_log.append_segment(envelopes(spark, first, last), f"{workdir}/in", number)
    stream = event_log.read_event_log(spark, f"{workdir}/in", max_events=45, events_per_task=7)
    assert stream.schema == schema.EVENT_ENVELOPE
    collect_ids(stream, workdir)
    found = rows(spark, workdir)
    assert sorted(r["event_id"] for r in found) == list(range(400))
    sizes = {}
    for r in found:
        sizes[r["batch"]] = sizes.get(r["batch"], 0) + 1
    assert len(sizes) == 9 and all(n == 45 for b, n in sizes.items() if b < 8) and sizes[8] == 400 - 8 * 45


def test_goes_on_after_a_failure_and_reads_new_segments(spark, workdir):
    event_log.append_segment(envelopes(spark, 0, 200), f"{workdir}/in", 0)

    def stream():
        return event_log.read_event_log(spark, f"{workdir}/in", routing_key="book", max_events=30, events_per_task=11)

    with pytest.raises(Exception, match="lost"):
        collect_ids(stream(), workdir, fail_at=2)
    assert {r["batch"] for r in rows(spark, workdir)} == {0, 1, 2}
    collect_ids(stream(), workdir)
    event_log.append_segment(envelopes(spark, 200, 260), f"{workdir}/in", 1)
    collect_ids(stream(), workdir)
    collect_ids(stream(), workdir)  # nothing new
    found = rows(spark, workdir)
    assert sorted(r["event_id"] for r in found) == [i for i in range(260) if i % 5 and i % 3]
    assert {r["routing_key"] for r in found} == {"book"}
    assert max(r["batch"] for r in found) == 8  # 7 batches of the first segment, 2 of the second


def test_one_batch_for_each_available_now(spark, workdir):
    event_log.append_segment(envelopes(spark, 0, 50), f"{workdir}/in", 0)
    for after in (20, 40, 50, 50):
        stream = event_log.read_event_log(spark, f"{workdir}/in", max_events=20)
        ingest.start_ingest(
            stream, HashingEmbedder(), f"{workdir}/out", routing_key="book", once=True).awaitTermination()
        titles = {r["doc_id"]: r["title"] for r in ingest.snapshot(spark, f"{workdir}/out").collect()}
        # which rows come first is the order of the files, here that of the events
        assert titles == {str(i % 40): str(i) for i in range(after) if i % 5 and i % 3}


def test_empty_and_missing_logs_give_nothing(spark, workdir):
    stream = event_log.read_event_log(spark, f"{workdir}/nowhere")
    collect_ids(stream, workdir)
    event_log.append_segment(envelopes(spark, 0, 0), f"{workdir}/in", 0)
    collect_ids(event_log.read_event_log(spark, f"{workdir}/in"), f"{workdir}/second")
    assert rows(spark, workdir) == rows(spark, f"{workdir}/second") == []


def test_incomplete_segments_hold_back_later_ones(spark, workdir):
    log = f"{workdir}/in"
    event_log.append_segment(envelopes(spark, 0, 10), log, 0)
    os.makedirs(f"{log}/{1:012d}")
    envelopes(spark, 20, 30).drop("body_of_a_wider_log").write.parquet(f"{log}/{2:012d}")
    collect_ids(event_log.read_event_log(spark, log), workdir)
    assert sorted(r["event_id"] for r in rows(spark, workdir)) == list(range(10))
    with pytest.raises(ValueError, match="not above"):
        event_log.append_segment(envelopes(spark, 10, 20), log, 1)
    envelopes(spark, 10, 20).write.mode("overwrite").parquet(f"{log}/{1:012d}")
    collect_ids(event_log.read_event_log(spark, log), workdir)
    assert sorted(r["event_id"] for r in rows(spark, workdir)) == list(range(30))


def test_a_segment_before_the_place_reached_is_an_error(spark, workdir):
    event_log.append_segment(envelopes(spark, 0, 10), f"{workdir}/in", 5)
    collect_ids(event_log.read_event_log(spark, f"{workdir}/in"), workdir)
    envelopes(spark, 10, 20).write.parquet(f"{workdir}/in/{3:012d}")
    with pytest.raises(Exception, match="was added before"):
        collect_ids(event_log.read_event_log(spark, f"{workdir}/in"), workdir)


def test_row_groups_without_the_key_are_not_read(spark, workdir, monkeypatch):
    event_log.append_segment(envelopes(spark, 0, 9, "aa").coalesce(1), f"{workdir}/in", 0)
    event_log.append_segment(envelopes(spark, 9, 18, "book").coalesce(1), f"{workdir}/in", 1)
    reader = event_log.EventLogReader(f"{workdir}/in", "book", 100, 100)
    ranges = reader.partitions(reader.initialOffset(), reader.latestOffset())
    read = []
    original = pq.ParquetFile.iter_batches

    def counted(self, *args, **kwargs):
        read.append(self.metadata.num_rows)
        return original(self, *args, **kwargs)

    monkeypatch.setattr(pq.ParquetFile, "iter_batches", counted)
    ids = [i for r in ranges for batch in reader.read(r) for i in batch.column("event_id").to_pylist()]
    assert ids == list(range(9, 18)) and len(ranges) == 2 and read == [9]


def test_limits_must_be_positive(spark, workdir):
    with pytest.raises(ValueError):
        event_log.read_event_log(spark, workdir, max_events=0)
