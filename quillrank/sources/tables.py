"""Readers and writers for relations, corpora and query sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillrank import schema
from quillrank.operators.topk import first_n


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    *,
    partition_column: str,
    lower: int | str,
    upper: int | str,
    partitions: int,
    properties: dict[str, str] | None = None,
) -> DataFrame:
    """One relation from a database, read in parallel key ranges.

    Needs the driver jar of the database on the class path.
    """
    return spark.read.jdbc(
        url, table, column=partition_column, lowerBound=lower, upperBound=upper,
        numPartitions=partitions, properties=properties or {},
    )


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.CORPUS).parquet(path)


def create_corpus_if_absent(spark: SparkSession, path: str) -> None:
    """An empty corpus with the fixed schema, unless one is already there."""
    spark.createDataFrame([], schema.CORPUS).write.mode("ignore").parquet(path)


def scan_corpus(corpus: DataFrame, limit: int | None = None) -> DataFrame:
    """Identified, titled documents with the columns that evaluation needs.

    ``limit`` is the caller's page size; the first documents by id are returned.
    """
    usable = corpus.where(
        F.col("doc_id").isNotNull() & (F.col("doc_id") != "")
        & F.col("title").isNotNull() & (F.col("title") != "")
    ).select("doc_id", "title", "synopsis")
    return usable if limit is None else first_n(usable, [F.asc("doc_id")], limit)


def write_query_set(qrels: DataFrame, path: str) -> None:
    """Save labelled queries with their ids as JSON lines."""
    _with_query_id(qrels).select("query_id", *[f.name for f in schema.QRELS]).write.mode("overwrite").json(path)


def read_query_set(spark: SparkSession, path: str, *, one_array: bool = False) -> DataFrame:
    """Load labelled queries from JSON lines, or from files that hold one JSON array each.

    Queries that were saved without an id get one from their content.
    """
    saved = T.StructType([T.StructField("query_id", T.StringType()), *schema.QRELS.fields])
    return _with_query_id(spark.read.schema(saved).option("multiLine", one_array).json(path))


def _with_query_id(qrels: DataFrame) -> DataFrame:
    content = F.sha2(F.to_json(F.struct(*[f.name for f in schema.QRELS])), 256)
    known = F.col("query_id").cast("string") if "query_id" in qrels.columns else F.lit(None).cast("string")
    return qrels.withColumn("query_id", F.coalesce(known, content))


def with_query_defaults(requests: DataFrame, *, limit: int, threshold: float) -> DataFrame:
    """Fill in the optional parameters of query requests."""
    return requests.select(
        "query_id", "q",
        F.coalesce(F.col("limit"), F.lit(limit)).cast("int").alias("limit"),
        F.coalesce(F.col("threshold"), F.lit(threshold)).cast("double").alias("threshold"),
    )


def in_bounds(min_limit: int, max_limit: int) -> Column:
    """True for requests whose parameters are acceptable."""
    return F.coalesce(
        F.col("q").isNotNull()
        & F.col("limit").between(min_limit, max_limit)
        & F.col("threshold").between(0.0, 1.0),
        F.lit(False),
    )
