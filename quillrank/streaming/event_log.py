"""Events from a growing log of Parquet segments, as a Python streaming data source.

The log is a folder of segments, each written once by ``append_segment`` and named by a
number that grows. Segments are read in the order of their names, once they are complete,
so the place of an event never changes. An offset names the next row: segment, file, row
in the file, and how many segments lie before. Nothing is remembered beside the
checkpoint of the query. A micro-batch takes at most ``max_events`` rows of the log, read
in ranges of rows by as many tasks. Only rows of the wanted routing key leave a task, and
row groups that cannot hold it are not read.

Defined results: an empty or missing log gives no rows; without a routing key all events
pass, with one an event whose key is NULL does not; further columns are not read. A
segment that is not complete holds back those after it. A segment that appears before the
place reached is an error, as its events would never be read; old ones may be removed.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from quillrank import schema

COMPLETE = "_SUCCESS"
_NAMES = [field.name for field in schema.EVENT_ENVELOPE]
_ARROW = pa.schema([
    ("event_id", pa.int64()), ("ts", pa.timestamp("us", tz="UTC")), ("routing_key", pa.string()), ("body", pa.string()),
])
_START = {"segment": "", "file": "", "row": 0, "before": 0}


def append_segment(events: DataFrame, path: str, number: int) -> None:
    """Write event envelopes as segment ``number``, which must be above all complete ones.

    A write that failed is repeated under its number; a complete segment stays as it is.
    """
    store, root = fs.FileSystem.from_uri(path)
    names, wanted = _segments(store, root), f"{number:012d}"
    complete = [name for name in names[bisect_left(names, wanted):] if COMPLETE in _files(store, f"{root}/{name}")]
    if complete:
        raise ValueError(f"segment {number} is not above the last complete one, {int(complete[-1])}")
    events.select(*_NAMES).write.mode("overwrite").parquet(f"{path}/{wanted}")


def read_event_log(
    spark: SparkSession, path: str, *, routing_key: str | None = None, max_events: int = 1_000_000,
    events_per_task: int = 50_000,
) -> DataFrame:
    """Event envelopes of the log below ``path``: a local folder, or one with the scheme of its file system.

    ``max_events`` counts rows of the log, whatever their routing key. A trigger of
    ``availableNow`` takes one micro-batch of this source; ``ingest.finish`` takes all.
    """
    if max_events < 1 or events_per_task < 1:
        raise ValueError("max_events and events_per_task must be at least 1")
    spark.dataSource.register(EventLog)
    reader = spark.readStream.format(EventLog.name()).option("maxEvents", max_events)
    reader = reader.option("eventsPerTask", events_per_task)
    return (reader if routing_key is None else reader.option("routingKey", routing_key)).load(path)


def _segments(store: fs.FileSystem, root: str) -> list[str]:
    found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted(f.base_name for f in found if f.type == fs.FileType.Directory and f.base_name[0] not in "_.")


def _files(store: fs.FileSystem, folder: str) -> list[str]:
    return sorted(f.base_name for f in store.get_file_info(fs.FileSelector(folder)) if f.is_file)


class EventRange(InputPartition):
    """Rows ``first`` to ``last`` (excluded) of one file of the log."""

    def __init__(self, file: str, first: int, last: int) -> None:
        super().__init__((file, first, last))
        self.file, self.first, self.last = file, first, last


class EventLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "event_log"

    def schema(self) -> StructType:
        return schema.EVENT_ENVELOPE

    def streamReader(self, schema: StructType) -> EventLogReader:
        options = self.options
        return EventLogReader(
            options["path"], options.get("routingKey"), int(options["maxEvents"]), int(options["eventsPerTask"]))


class EventLogReader(DataSourceStreamReader):
    def __init__(self, path: str, routing_key: str | None, max_events: int, events_per_task: int) -> None:
        self.path, self.routing_key = path, routing_key
        self.max_events, self.events_per_task = max_events, events_per_task
        self.reached = dict(_START)

    def initialOffset(self) -> dict:
        return dict(_START)

    def latestOffset(self) -> dict:
        """The place ``max_events`` rows after the one reached, or the end of the complete segments."""
        place, left = self.reached, self.max_events
        for before, segment, file, rows in self._from(self.reached):
            done = place["row"] if (segment, file) == (place["segment"], place["file"]) else 0
            taken = min(left, rows - done)
            if taken:
                place = {"segment": segment, "file": file, "row": done + taken, "before": before}
                left -= taken
            if not left:
                break
        return place

    def partitions(self, start: dict, end: dict) -> list[EventRange]:
        """Ranges of rows between two places.

        A restarted query first plans the empty range at its last offset, so the reader
        knows the place reached before it is asked for the next one.
        """
        self.reached = end
        _, root = fs.FileSystem.from_uri(self.path)
        ranges = []
        for _, segment, file, rows in self._from(start):
            if (segment, file) > (end["segment"], end["file"]):
                break
            first = start["row"] if (segment, file) == (start["segment"], start["file"]) else 0
            last = end["row"] if (segment, file) == (end["segment"], end["file"]) else rows
            ranges += [
                EventRange(f"{root}/{segment}/{file}", at, min(at + self.events_per_task, last))
                for at in range(first, last, self.events_per_task)
            ]
        return ranges

    def read(self, partition: EventRange) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.path)
        with store.open_input_file(partition.file) as opened:
            table = pq.ParquetFile(opened, coerce_int96_timestamp_unit="us")
            begin = 0
            for number in range(table.num_row_groups):
                group = table.metadata.row_group(number)
                end = begin + group.num_rows
                if begin < partition.last and end > partition.first and self._may_hold(group):
                    yield from self._group(table, number, partition.first - begin, partition.last - begin)
                begin = end

    def _from(self, place: dict[str, Any]) -> Iterator[tuple[int, str, str, int]]:
        """Segments before, segment, file and rows of the files from a place on, in order."""
        store, root = fs.FileSystem.from_uri(self.path)
        names = _segments(store, root)
        first = bisect_left(names, place["segment"])
        if first > place["before"]:
            raise RuntimeError(f"a segment was added before {place['segment']}, which has been reached: {names[:first]}")
        for before in range(first, len(names)):
            segment = names[before]
            files = _files(store, f"{root}/{segment}")
            if COMPLETE not in files:
                return
            for file in files:
                if file.endswith(".parquet") and (segment, file) >= (place["segment"], place["file"]):
                    with store.open_input_file(f"{root}/{segment}/{file}") as opened:
                        rows = pq.read_metadata(opened).num_rows
                    yield before, segment, file, rows

    def _may_hold(self, group: pq.RowGroupMetaData) -> bool:
        """False if the statistics of a row group exclude the routing key."""
        for at in range(group.num_columns if self.routing_key is not None else 0):
            column = group.column(at)
            if column.path_in_schema == "routing_key" and column.statistics and column.statistics.has_min_max:
                return column.statistics.min <= self.routing_key <= column.statistics.max
        return True

    def _group(self, table: pq.ParquetFile, number: int, first: int, last: int) -> Iterator[pa.RecordBatch]:
        """Wanted events among rows ``first`` to ``last`` of a row group."""
        begin = 0
        for batch in table.iter_batches(batch_size=4096, row_groups=[number], columns=_NAMES):
            low, high = max(first - begin, 0), min(last - begin, batch.num_rows)
            begin += batch.num_rows
            if low >= high:
                continue
            rows = batch.slice(low, high - low).select(_NAMES)
            if self.routing_key is not None:
                rows = rows.filter(pc.equal(rows.column("routing_key"), self.routing_key))
            if rows.num_rows:
                yield pa.RecordBatch.from_arrays(
                    [column.cast(field.type) for column, field in zip(rows.columns, _ARROW)], schema=_ARROW)
