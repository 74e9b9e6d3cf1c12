"""Intermediate tables in the shared folder of the cluster.

Results that several stages read are written once and read back. The written
table survives the loss of executors and ends the lineage.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, DataFrameWriter, Observation, Row, SparkSession
from pyspark.sql import functions as F

_local_roots: dict[str, str] = {}
_scratch: list[list[str]] = []
_CHARS_PER_ROW = 16
#: Input that makes a bucket of its own: the postings of so much text are sorted in memory by one task.
_BUCKET_BYTES = 16 << 20
#: Options of the files of an index: as fast as the default here, and half the size.
SMALL_FILES = {"compression": "zstd", "parquet.compression.codec.zstd.level": "1"}
#: Shuffle files go when the table that is made of them is written, not when the driver next collects garbage.
_SHUFFLES_GO = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: Bucket files are read in a task each, also where nothing needs the grouping.
_ONE_TASK_PER_BUCKET = {"spark.sql.sources.bucketing.autoBucketedScan.enabled": "false"}


def workspace_root(spark: SparkSession) -> str:
    """Shared folder named by ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = context.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="quillrank-")
    return _local_roots[app]


def new_folder(spark: SparkSession, label: str) -> str:
    """A folder name that no earlier run has used; Spark creates it on write."""
    path = f"{workspace_root(spark)}/quillrank/{label}-{uuid.uuid4().hex}"
    for paths in _scratch:
        paths.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Folders named inside the block are removed at its end, so its result must be written elsewhere by then."""
    paths: list[str] = []
    _scratch.append(paths)
    try:
        yield
    finally:
        _scratch[:] = [other for other in _scratch if other is not paths]
        discard(spark, *paths)


def discard(spark: SparkSession, *paths: str) -> None:
    """Remove written tables that no later stage reads."""
    configuration = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(configuration).delete(folder, True)


@dataclass(frozen=True)
class Stored:
    """A written table together with its exact number of rows."""

    df: DataFrame
    rows: int
    path: str
    totals: dict[str, Any]

    @property
    def weight(self) -> int:
        """Rows to compare with a bound on rows; long texts, if ``chars`` were counted, weigh more."""
        return max(self.rows, (self.totals.get("chars") or 0) // _CHARS_PER_ROW)


def store(
    df: DataFrame, label: str, partition_by: str | None = None, totals: dict[str, Column] | None = None,
    options: dict[str, str] | None = None,
) -> Stored:
    """Write ``df`` once and read it back.

    The rows are counted on the way; ``totals`` are further aggregates to take
    during the same pass, ``options`` those of the Parquet files.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    seen = Observation()
    extra = [column.alias(name) for name, column in (totals or {}).items()]
    writer = df.observe(seen, F.count(F.lit(1)).alias("rows"), *extra).write.options(**(options or {}))
    if partition_by is not None:
        writer = writer.partitionBy(partition_by)
    with _settings(spark, _SHUFFLES_GO):
        writer.parquet(path)
    values = dict(seen.get)
    return Stored(spark.read.schema(df.schema).parquet(path), values["rows"], path, values)


def without_dictionary(*columns: str) -> dict[str, str]:
    """Options of Parquet files for columns whose values hardly repeat within a file."""
    return {f"parquet.enable.dictionary#{column}": "false" for column in columns}


def bucket_count(spark: SparkSession, wanted: int | None = None, *rows: DataFrame) -> int:
    """Number of buckets of stored tables: as asked, else that of a shuffle.

    A local session has no use for many more parts than cores, unless the files that
    ``rows`` are read from are so large that a bucket would outgrow the memory of a task.
    """
    if wanted:
        return wanted
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if spark.sparkContext.master.startswith("local"):
        parts = min(parts, 2 * spark.sparkContext.defaultParallelism)
    return max(parts, -(-_bytes_read(spark, rows) // _BUCKET_BYTES))


def _bytes_read(spark: SparkSession, rows: Sequence[DataFrame]) -> int:
    """Size of the files below ``rows``, each once; rows that come from elsewhere have none."""
    configuration, path = spark.sparkContext._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    folders: dict[str, set[str]] = {}
    for name in {name for df in rows for name in df.inputFiles()}:
        file = path(spark._jvm.java.net.URI(name))
        folders.setdefault(file.getParent().toString(), set()).add(file.getName())
    return sum(
        status.getLen() for folder, names in folders.items()
        for status in path(folder).getFileSystem(configuration).listStatus(path(folder))
        if status.getPath().getName() in names
    )


def newest_row(spark: SparkSession, path: str, schema: str, by: str) -> Row | None:
    """The row with the largest ``by`` of a small table, or None where nothing was written yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.schema(schema).parquet(path).orderBy(by, ascending=False).first()


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Jobs planned inside the block run with other settings of the session."""
    before = {name: spark.conf.get(name) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def save_bucketed(writer: DataFrameWriter, spark: SparkSession, path: str, name: str, buckets: int,
                  sort_by: list[str] | None = None) -> None:
    """Write a table whose rows are grouped by document into ``buckets`` buckets.

    Rows of a bucketed table stay in a task for each bucket, so no task sorts several of them.
    """
    writer = writer.format("parquet").options(**SMALL_FILES).option("path", path).bucketBy(buckets, "doc_id")
    with _settings(spark, {**_SHUFFLES_GO, **_ONE_TASK_PER_BUCKET}):
        (writer.sortBy(*sort_by) if sort_by else writer).saveAsTable(name)


def store_bucketed(writer: DataFrameWriter, spark: SparkSession, label: str, buckets: int,
                   sort_by: list[str] | None = None) -> DataFrame:
    """The rows in buckets by document, in a new folder.

    Later joins and aggregations by document read it without a shuffle.
    """
    path = new_folder(spark, label)
    name = f"quillrank_{path.rsplit('/', 1)[1].replace('-', '_')}"
    save_bucketed(writer, spark, path, name, buckets, sort_by)
    return spark.table(name)
