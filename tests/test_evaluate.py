import math

import pytest
from pyspark.sql import functions as F

from quillrank import HashingEmbedder, RetrievalConfig, bulk_index, evaluate
from quillrank.operators.corpus import normalize
from quillrank.operators.evaluate import (
    generate_queries, metrics_long, metrics_wide, style_counts, styled_queries,
)
from quillrank.plans.evaluation import judge_runs

BOOKS = [
    ("1", "Deep river crossing", "Deep river crossing by Ann Lee, Bob Ray. Published in 1999. Subjects: Rivers, Travel."),
    ("2", "Map", "Map by Carl. Published in 2001. Subjects: Maps."),
    ("3", "Plain book title", "no structure at all"),
]


@pytest.fixture(scope="module")
def books(spark):
    return spark.createDataFrame(BOOKS, "doc_id string, title string, synopsis string")


def texts(df):
    return {r["query_id"]: r["query"] for r in df.collect()}


def test_styles(books):
    keyword = texts(styled_queries(books, "keyword", 1))
    assert set(keyword) == {"1", "3"}
    assert set(keyword["1"].split()) == {"Deep", "river", "crossing"}
    assert texts(styled_queries(books, "author", 1)) == {"1": "books by Ann Lee", "2": "books by Carl"}
    assert texts(styled_queries(books, "year", 1)) == {"1": "Rivers from 1999", "2": "Maps from 2001"}
    subject = texts(styled_queries(books, "subject", 1))
    assert subject["1"] in {"Rivers", "Travel"} and subject["2"] == "Maps"


def test_generation_repeats_and_ignores_unknown_styles(books):
    draw = [texts(generate_queries(books, 2, ["author", "nonsense"], 3)) for _ in range(2)]
    assert draw[0] == draw[1] == {"1": "books by Ann Lee", "2": "books by Carl"}
    assert generate_queries(books, 2, ["nonsense"], 3).isEmpty()
    one = generate_queries(books, 1, ["keyword"], 3)
    assert one.count() == 1
    assert [r["n_queries"] for r in style_counts(one).collect()] == [1]


def test_metrics_by_hand(spark):
    qrels = spark.createDataFrame(
        [(str(i), str(i), "keyword") for i in range(1, 5)], "query_id string, relevant_id string, style string")
    ranked = spark.createDataFrame(
        [("1", "1", 1), ("2", "x", 1), ("2", "2", 3), ("3", "3", 11)], "query_id string, doc_id string, rank int")
    runs = judge_runs(qrels, ranked.withColumn("method", F.lit("BM25")))
    long = metrics_long(runs.where("method = 'BM25'").withColumn("method", F.lit("m")))
    got = {r["metric"]: r["value"] for r in long.collect()}
    assert got["Hit@1"] == 0.25 and got["Hit@5"] == 0.5 and got["Hit@10"] == 0.5
    assert got["MRR@10"] == pytest.approx((1 + 1 / 3) / 4)
    assert got["NDCG@10"] == pytest.approx((1 + 1 / math.log2(4)) / 4)
    wide = metrics_wide(long).first()
    assert wide["method"] == "m" and wide["MRR@10"] == round((1 + 1 / 3) / 4, 4)


def test_whole_evaluation(spark, books):
    rows = books.withColumnRenamed("doc_id", "book_id")
    index = bulk_index(normalize(rows), HashingEmbedder(), RetrievalConfig())
    qrels = styled_queries(books, "keyword", 1)
    values = {(r["method"], r["metric"]): r["value"] for r in evaluate(qrels, index, RetrievalConfig()).collect()}
    assert len(values) == 15
    for method in ("BM25", "Dense", "Hybrid-RRF"):
        assert values[method, "Hit@1"] == 1.0
        assert values[method, "Hit@1"] <= values[method, "Hit@5"] <= values[method, "Hit@10"]
        assert values[method, "MRR@10"] <= values[method, "NDCG@10"]
