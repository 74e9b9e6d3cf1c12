"""How the given tables play the roles of the document model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillrank import HashingEmbedder, RetrievalConfig, SearchIndex, bulk_index
from quillrank.operators.corpus import assemble, normalize

EVENT_SCHEMA = (
    "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
)
ROUTING_KEY = "signup"
SEED = 7

_indexes: dict[tuple[str, str, str], SearchIndex] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def config() -> RetrievalConfig:
    return RetrievalConfig()


# --- documents as a corpus, benchmark passages as free-text queries ----------


def document_rows(spark: SparkSession, sf: str) -> DataFrame:
    """``documents`` with the first line as title and the source as author and publisher."""
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("book_id"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.col("text").alias("synopsis"),
        F.array("source", F.lit(None), F.lit("")).alias("authors"),
        F.array("lang").alias("genres"),
        F.col("source").alias("publisher"),
        F.when(F.col("lang") == "en", F.concat(F.lit("covers/"), F.col("doc_id"))).alias("book_picture"),
        F.when(F.col("lang") != "es", F.concat(F.lit("other/"), F.col("doc_id"))).alias("bookPicture"),
    )


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return normalize(document_rows(spark, sf))


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """Every benchmark passage as a search request with its own limit and threshold."""
    item = F.col("item_id")
    return table(spark, sf, "benchmark").select(
        item.cast("string").alias("query_id"),
        F.col("text").alias("q"),
        F.when(item % 3 != 0, item % 50 + 1).cast("int").alias("limit"),
        F.when(item % 4 == 0, 0.02).when(item % 4 == 1, 0.0).alias("threshold"),
    )


def free_queries(spark: SparkSession, sf: str) -> DataFrame:
    return requests(spark, sf).select("query_id", "q")


def document_index(spark: SparkSession, sf: str) -> SearchIndex:
    return _indexed(spark, sf, "documents")


def order_index(spark: SparkSession, sf: str) -> SearchIndex:
    return _indexed(spark, sf, "orders")


def _indexed(spark: SparkSession, sf: str, name: str) -> SearchIndex:
    """The stored index of a corpus; built when a session first asks for it."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _indexes:
        corpus = documents(spark, sf) if name == "documents" else order_documents(spark, sf)
        _indexes[key] = bulk_index(corpus, HashingEmbedder(), config())
    return _indexes[key]


# --- six relations: orders as books, customers as publishers -----------------


def relations(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    orders = table(spark, sf, "orders")
    customer = table(spark, sf, "customer")
    lineitem = table(spark, sf, "lineitem")
    buyers = customer.select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    synopsis = F.concat(
        F.lit("Order "), F.col("o_orderkey"), F.lit(" by "), F.col("c_name"),
        F.lit(". Published in "), F.year("o_orderdate"),
        F.lit(". Subjects: "), F.col("o_orderpriority"), F.lit(", "), F.col("c_mktsegment"), F.lit("."),
    )
    return {
        "book": orders.join(buyers, "o_custkey", "left").select(
            F.col("o_orderkey").alias("id"),
            F.concat(F.lit("Order "), F.col("o_orderkey")).alias("title"),
            synopsis.alias("synopsis"),
            F.lit(None).cast("string").alias("book_picture"),
            F.col("o_custkey").alias("id_publisher"),
        ),
        "publisher": customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")),
        "author": table(spark, sf, "supplier").select(
            F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")),
        "genre": table(spark, sf, "part").select(
            F.col("p_partkey").alias("id"), F.col("p_name").alias("genre")),
        "authored_by": lineitem.select(
            F.col("l_orderkey").alias("id_book"), F.col("l_suppkey").alias("id_author")),
        "having_genre": lineitem.select(
            F.col("l_orderkey").alias("id_book"), F.col("l_partkey").alias("id_genre")),
    }


def order_documents(spark: SparkSession, sf: str) -> DataFrame:
    return normalize(assemble(**relations(spark, sf)))


# --- vectors ------------------------------------------------------------------


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("doc_id"), F.col("embedding").alias("vector"), "label"
    )


def label_centres(spark: SparkSession, sf: str) -> DataFrame:
    """Mean vector of every label, averaged per dimension before it becomes an array."""
    cells = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    means = cells.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy("label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda c: c["x"]).alias("vector")
    )


# --- ranked lists that do not depend on text ---------------------------------


def order_lists(spark: SparkSession, sf: str, mirrored: bool) -> tuple[DataFrame, DataFrame]:
    """Two rankings of the orders of every customer.

    The first is by price. The second is the same backwards, which makes many
    ties, or by date.
    """
    rows = table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("query_id"),
        F.col("o_orderkey").cast("string").alias("doc_id"),
        F.col("o_totalprice").alias("price"), F.col("o_orderdate").alias("day"),
        F.col("o_orderpriority").alias("title"),
    )
    other = [F.asc("price"), F.desc("doc_id")] if mirrored else [F.desc("day"), F.asc("doc_id")]

    def ranked(order: list[Column]) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))

    return ranked([F.desc("price"), F.asc("doc_id")]), ranked(other)


# --- events -------------------------------------------------------------------


def envelopes(events: DataFrame) -> DataFrame:
    """``events`` as messages: some bodies lack a field, name it differently or are cut off."""
    eid = F.col("event_id")
    id_name = F.when(eid % 7 == 0, "bookId").otherwise("id")
    title = F.when(eid % 11 == 0, "").otherwise(F.concat(F.lit("User "), F.col("user_id")))
    synopsis = F.when(eid % 17 == 0, "").otherwise(F.concat(
        F.lit(',"synopsis":"'), F.col("event_type"), F.lit(" "), F.col("value"), F.lit('"')))
    end = F.when(eid % 13 == 0, "").otherwise("}")
    body = F.concat(
        F.lit('{"'), id_name, F.lit('":"'), F.col("user_id"), F.lit('","title":"'), title, F.lit('"'),
        synopsis, end,
    )
    return events.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("routing_key"), body.alias("body"),
    )


def event_table(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events")


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    return (
        spark.readStream.schema(EVENT_SCHEMA).option("pathGlobFilter", "events.parquet")
        .option("maxFilesPerTrigger", 10).parquet(sf)
    )


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))
