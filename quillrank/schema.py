"""Explicit schemas of every table the library reads or writes."""

from pyspark.sql import types as T

CORPUS = T.StructType([
    T.StructField("doc_id", T.StringType(), False),
    T.StructField("title", T.StringType()),
    T.StructField("synopsis", T.StringType()),
    T.StructField("authors", T.ArrayType(T.StringType())),
    T.StructField("genres", T.ArrayType(T.StringType())),
    T.StructField("publisher", T.StringType()),
    T.StructField("book_picture", T.StringType()),
    T.StructField("vector", T.ArrayType(T.FloatType())),
])

QUERIES = T.StructType([
    T.StructField("query_id", T.StringType(), False),
    T.StructField("q", T.StringType()),
    T.StructField("limit", T.IntegerType()),
    T.StructField("threshold", T.DoubleType()),
])

RANKED = T.StructType([
    T.StructField("query_id", T.StringType(), False),
    T.StructField("rank", T.IntegerType(), False),
    T.StructField("doc_id", T.StringType(), False),
    T.StructField("score", T.DoubleType()),
])

# A saved query set has the labelled query first, then what it was made from.
QRELS = T.StructType([
    T.StructField("query", T.StringType()),
    T.StructField("relevant_id", T.StringType()),
    T.StructField("style", T.StringType()),
    T.StructField("title", T.StringType()),
])

# ``corrupt`` receives bodies that are not JSON objects.
EVENT_BODY = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("bookId", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("synopsis", T.StringType()),
    T.StructField("bookPicture", T.StringType()),
    T.StructField("corrupt", T.StringType()),
])

EVENT_ENVELOPE = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("routing_key", T.StringType()),
    T.StructField("body", T.StringType()),
])

RESULT_ITEMS = T.ArrayType(T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("bookPicture", T.StringType()),
    T.StructField("score", T.DoubleType()),
]))

CACHE = T.StructType([
    T.StructField("key", T.StringType(), False),
    T.StructField("payload", T.StringType()),
    T.StructField("written_at", T.TimestampType()),
    T.StructField("expires_at", T.TimestampType()),
])

POSTING = T.ArrayType(T.StructType([
    T.StructField("term", T.StringType()),
    T.StructField("tf", T.IntegerType()),
]))
