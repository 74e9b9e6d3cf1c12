import pytest
from pyspark.sql import functions as F

from quillrank.operators.fuse import candidate_depth, cut, first_hits, rerank_head, rrf_fuse, within_depth


def ranked(spark, lists):
    rows = [(q, i + 1, d) for q, docs in lists.items() for i, d in enumerate(docs)]
    return spark.createDataFrame(rows, "query_id string, rank int, doc_id string")


def order_of(df, query="q"):
    rows = df.where(F.col("query_id") == query).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
    return [r["doc_id"] for r in rows]


def stable_merge(first, second, k=60):
    """The rule in plain Python: sum the reciprocal ranks, sort stably."""
    total = {}
    for docs in (first, second):
        for place, doc in enumerate(docs, 1):
            total[doc] = total.get(doc, 0.0) + 1.0 / (k + place)
    return sorted(total, key=lambda d: -total[d]), total


def test_mirrored_lists_tie_in_lexical_order(spark):
    fused = rrf_fuse(ranked(spark, {"q": ["a", "b"]}), ranked(spark, {"q": ["b", "a"]}))
    assert order_of(fused) == ["a", "b"]
    scores = {r["score"] for r in fused.collect()}
    assert len(scores) == 1


def test_one_sided_hits_and_bounds(spark):
    fused = rrf_fuse(ranked(spark, {"q": ["a", "b"]}), ranked(spark, {"q": ["c", "a"], "r": ["z"]}))
    assert order_of(fused) == ["a", "c", "b"]
    assert order_of(fused, "r") == ["z"]
    assert max(r["score"] for r in fused.collect()) <= 2 / 61


def test_random_lists_match_stable_sort(spark):
    import random

    rng = random.Random(1)
    first, second, want = {}, {}, {}
    for n in range(30):
        pool = [f"d{i:02d}" for i in range(25)]
        a, b = rng.sample(pool, rng.randint(0, 20)), rng.sample(pool, rng.randint(0, 20))
        first[str(n)], second[str(n)] = a, b
        want[str(n)] = stable_merge(a, b)[0]
    fused = rrf_fuse(ranked(spark, first), ranked(spark, second)).collect()
    for query, docs in want.items():
        got = [r["doc_id"] for r in sorted(fused, key=lambda r: r["rank"]) if r["query_id"] == query]
        assert got == docs


def test_limit_applies_before_threshold(spark):
    rows = [("q", 1, "a", 0.5), ("q", 2, "b", 0.1), ("q", 3, "c", 0.4)]
    scored = spark.createDataFrame(rows, "query_id string, rank int, doc_id string, score double")

    def kept(limit, threshold):
        wanted = spark.createDataFrame([("q", limit, threshold)], "query_id string, limit int, threshold double")
        return sorted(r["doc_id"] for r in cut(scored, wanted).collect())

    assert kept(2, 0.3) == ["a"]
    assert kept(3, 0.4) == ["a", "c"]
    assert kept(3, 0.0) == ["a", "b", "c"]


def test_depth_rule(spark):
    df = spark.createDataFrame([(1,), (5,), (6,), (50,)], "n int")
    assert [r[0] for r in df.select(candidate_depth(F.col("n"))).collect()] == [20, 20, 24, 200]
    docs = ranked(spark, {"q": [f"d{i:03d}" for i in range(100)]})
    wanted = spark.createDataFrame([("q", 6)], "query_id string, limit int")
    assert within_depth(docs, wanted).count() == 24


def test_first_hit_is_the_lexical_copy(spark):
    a = spark.createDataFrame([("q", "x", "lex")], "query_id string, doc_id string, title string")
    b = spark.createDataFrame([("q", "x", "den"), ("q", "y", "den")], "query_id string, doc_id string, title string")
    got = {r["doc_id"]: (r["title"], r["source"]) for r in first_hits(a, b, ["title"]).collect()}
    assert got == {"x": ("lex", "bm25"), "y": ("den", "knn")}


@pytest.fixture
def five(spark):
    rows = [("q", i, f"d{i}", 1.0 / i, s) for i, s in enumerate([0.1, 0.9, 0.9, 5.0, 7.0], 1)]
    return spark.createDataFrame(rows, "query_id string, rank int, doc_id string, score double, s double")


def test_head_moves_tail_stays(five):
    out = rerank_head(five, F.col("s"), top_k=3)
    assert order_of(out) == ["d2", "d3", "d1", "d4", "d5"]
    rows = {r["doc_id"]: r for r in out.collect()}
    assert rows["d2"]["score"] == 0.9 and rows["d2"]["rrf_score"] == 0.5
    assert rows["d4"]["score"] == 0.25


def test_failed_scorer_keeps_fused_order(five):
    broken = F.when(F.col("doc_id") != "d2", F.col("s"))
    out = rerank_head(five, broken, top_k=3)
    assert order_of(out) == ["d1", "d2", "d3", "d4", "d5"]
    assert all(r["score"] == r["rrf_score"] for r in out.collect())


def test_cut_keeps_long_pages(spark):
    ranked = spark.createDataFrame([("q", i, f"d{i}", 1.0) for i in range(1, 81)], "query_id string, rank int, doc_id string, score double")
    wanted = spark.createDataFrame([("q", 60, 0.0)], "query_id string, limit int, threshold double")
    assert cut(ranked, wanted).count() == 60
