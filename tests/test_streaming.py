import json
import os

import pytest
from pyspark.sql import functions as F

from quillrank import HashingEmbedder, RetrievalConfig, apply_changes, bulk_index, hybrid_search, schema
from quillrank.streaming import events as ev
from quillrank.streaming import ingest


def message(event_id, ts, body, key="book.created"):
    return {"event_id": event_id, "ts": ts, "routing_key": key,
            "body": body if isinstance(body, str) else json.dumps(body)}


def drop_file(folder, name, messages):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}.json", "w", encoding="utf-8") as out:
        out.writelines(json.dumps(m) + "\n" for m in messages)


FIRST = [
    message(1, "2024-01-01T00:00:01Z", {"id": "a", "title": "A1", "synopsis": "one"}),
    message(2, "2024-01-01T00:00:05Z", {"bookId": "b", "title": "B", "bookPicture": "pic"}),
    message(3, "2024-01-01T00:00:03Z", {"id": "a", "title": "A3"}),
    message(4, "2024-01-01T00:00:04Z", {"title": "no id"}),
    message(5, "2024-01-01T00:00:04Z", {"id": "c", "title": ""}),
    message(6, "2024-01-01T00:00:04Z", '{"id": "d", "title": "cut off"'),
    message(7, "2024-01-01T00:00:04Z", {"id": "e", "title": "other topic"}, key="book.deleted"),
    message(8, "2024-01-01T00:00:04Z", "not json"),
    message(9, "2024-01-01T00:00:04Z", {"id": 12, "title": "numeric id", "synopsis": None}),
]
LATE = [
    message(10, "2024-01-01T00:00:02Z", {"id": "a", "title": "A2 arrives late"}),
    message(11, "2024-01-01T00:00:09Z", {"id": "b", "title": "B2"}),
]


def consume(spark, source, target):
    stream = ev.read_event_files(spark, source, max_files=1)
    ingest.start_ingest(
        stream, HashingEmbedder(), target, routing_key="book.created", once=True).awaitTermination()
    return {r["doc_id"]: r for r in ingest.snapshot(spark, target).collect()}


def test_ingest_survives_restarts_and_late_events(spark, workdir):
    source, target = f"{workdir}/in", f"{workdir}/out"
    drop_file(source, "1", FIRST)
    first = consume(spark, source, target)
    assert {d: r["title"] for d, r in first.items()} == {"a": "A3", "b": "B", "12": "numeric id"}
    assert first["b"]["book_picture"] == "pic" and first["12"]["synopsis"] == ""
    assert len(first["a"]["vector"]) == 384
    reasons = {r["event_id"]: r["reason"] for r in ingest.read_rejected(spark, target).collect()}
    assert reasons == {4: ev.NO_ID, 5: ev.NO_TITLE, 6: ev.MALFORMED, 8: ev.MALFORMED}

    drop_file(source, "2", LATE)
    second = consume(spark, source, target)  # a new query continues from the checkpoint
    assert {d: r["title"] for d, r in second.items()} == {"a": "A3", "b": "B2", "12": "numeric id"}
    touched = ingest.changes(spark, target, 0)
    assert {r["doc_id"]: r["title"] for r in touched.collect()} == {"a": "A3", "b": "B2"}
    index = bulk_index(ingest.snapshot(spark, target), HashingEmbedder(), RetrievalConfig())
    index = apply_changes(index, touched, RetrievalConfig())
    found = hybrid_search(
        spark.createDataFrame([("q", "b2", 1, 0.0)], schema.QUERIES), index, RetrievalConfig())
    assert [r["id"] for r in found.collect()] == ["b"]
    assert consume(spark, source, target).keys() == second.keys()
    assert ingest.read_log(spark, target).count() == 5


def test_compaction_changes_no_snapshot(spark, workdir):
    source, target = f"{workdir}/in", f"{workdir}/out"

    def rows(df):
        return sorted(df.drop("vector").collect(), key=lambda r: r["doc_id"])

    drop_file(source, "1", FIRST)
    consume(spark, source, target)
    before = rows(ingest.snapshot(spark, target))
    ingest.compact(spark, target, 0)
    assert rows(ingest.snapshot(spark, target)) == before
    # A late event loses against the compacted version, a new one wins.
    drop_file(source, "2", LATE)
    after = consume(spark, source, target)
    assert {d: r["title"] for d, r in after.items()} == {"a": "A3", "b": "B2", "12": "numeric id"}
    plain = rows(ingest.snapshot(spark, target))
    touched = rows(ingest.changes(spark, target, 0))
    ingest.compact(spark, target, 1)
    assert rows(ingest.snapshot(spark, target)) == plain
    assert rows(ingest.changes(spark, target, 0)) == touched
    # Compacting an earlier batch again does not go back.
    ingest.compact(spark, target, 0)
    assert rows(ingest.snapshot(spark, target)) == plain
    # Three documents of the snapshot are read, and none of the five rows of the log.
    assert ingest._versions(spark, target).count() == 3 and ingest.read_log(spark, target).count() == 5


def test_replayed_batch_changes_nothing(spark, workdir):
    rows = spark.createDataFrame(
        [(m["event_id"], m["ts"], m["routing_key"], m["body"]) for m in FIRST],
        "event_id long, ts string, routing_key string, body string",
    ).withColumn("ts", F.col("ts").cast("timestamp"))
    decoded = ev.decode(ev.routed(rows))
    for _ in range(2):
        ingest.write_batch(decoded, 0, HashingEmbedder(), workdir)
    assert ingest.read_log(spark, workdir).count() == 3
    assert ingest.read_rejected(spark, workdir).count() == 4


def test_redelivered_events_pass_once(spark, workdir):
    source = f"{workdir}/in"
    drop_file(source, "1", FIRST)
    drop_file(source, "2", FIRST[:3])
    stream = ev.without_redelivered(ev.read_event_files(spark, source, max_files=1))
    (stream.writeStream.format("parquet").option("path", f"{workdir}/out")
     .option("checkpointLocation", f"{workdir}/ck").trigger(availableNow=True).start().awaitTermination())
    assert spark.read.parquet(f"{workdir}/out").count() == len(FIRST)


def test_late_events_are_let_through(spark, workdir):
    source = f"{workdir}/in"
    days = ["2024-01-20", "2024-01-01", "2024-01-25", "2024-01-02"]
    for i, day in enumerate(days):
        drop_file(source, str(i), [{**FIRST[0], "event_id": 500 + i, "ts": f"{day} 00:00:00"}])
    stream = ev.without_redelivered(ev.read_event_files(spark, source, max_files=1))
    (stream.writeStream.format("parquet").option("path", f"{workdir}/out")
     .option("checkpointLocation", f"{workdir}/ck").trigger(availableNow=True).start().awaitTermination())
    assert sorted(r["event_id"] for r in spark.read.parquet(f"{workdir}/out").collect()) == [500, 501, 502, 503]


def test_topic_ids_differ_between_partitions(spark):
    rows = spark.createDataFrame([(0, 7), (1, 7), (1, 8)], "partition int, offset long")
    ids = [r[0] for r in rows.select(ev.topic_event_id(F.col("partition"), F.col("offset"))).collect()]
    assert len(set(ids)) == 3 and ids == sorted(ids)


def test_running_latest_per_key(spark, workdir):
    source = f"{workdir}/in"
    drop_file(source, "1", FIRST)
    drop_file(source, "2", LATE)
    stream = ev.accepted(ev.decode(ev.routed(ev.read_event_files(spark, source, max_files=1))))
    slim = stream.select("doc_id", "event_id", "ts", "title")
    ingest.start_latest(ev.latest_by_key(slim), f"{workdir}/out", once=True).awaitTermination()
    rows = ingest.read_latest(
        spark, f"{workdir}/out", "doc_id string, event_id bigint, ts timestamp, title string")
    assert {r["doc_id"]: r["title"] for r in rows.collect()} == {"a": "A3", "b": "B2", "12": "numeric id"}


@pytest.mark.parametrize("key, count", [("book.created", 8), ("book.deleted", 1), ("none", 0)])
def test_routing(spark, key, count):
    rows = spark.createDataFrame([(m["routing_key"],) for m in FIRST], "routing_key string")
    assert ev.routed(rows, key).count() == count
