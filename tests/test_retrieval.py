import glob
import math
import os
import random
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillrank import (
    HashingEmbedder, ModelEmbedder, ModelScorer, RetrievalConfig, apply_changes, bulk_index,
    hybrid_search, memoised_search, rebuild, validate, with_cells,
)
from quillrank import schema
from quillrank.functions.vectors import dot, l2_norm, l2_normalize
from quillrank.operators import scoring, topk
from quillrank.operators.corpus import documents_named, normalize
from quillrank.operators.dense import build_cells, knn_approx, knn_exact, knn_lsh
from quillrank.operators.fuzzy import expand_terms, similar_terms
from quillrank.operators.lexical import bm25_scores, bm25_top, query_weights
from quillrank.operators.topk import top_k
from quillrank.plans.stored_index import open_index, save_index
from quillrank.sources import workspace
from quillrank.sources.workspace import bucket_count, store

DOCS = [
    ("1", "Clean architecture", "a guide to software architecture", ["Robert Martin"], ["Software"], "Hall"),
    ("2", "Garden birds", "the birds of the garden the garden", ["Ann Lee"], ["Nature"], "Green"),
    ("3", "Software garden", "growing software", ["Ann Martin", None, ""], ["Software", "Nature"], None),
    ("4", "Empty", None, None, None, ""),
]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = spark.createDataFrame(
        DOCS, "book_id string, title string, synopsis string, authors array<string>, "
              "genres array<string>, publisher string")
    return normalize(rows)


@pytest.fixture(scope="module")
def index(corpus):
    return bulk_index(corpus, HashingEmbedder(), RetrievalConfig())


def queries_of(spark, **texts):
    return spark.createDataFrame(list(texts.items()), "query_id string, q string")


def as_lists(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
    return out


def brute_bm25(docs, query, weights, k1=1.2, b=0.75):
    """Plain scoring of already analysed documents: ``{doc: {field: tokens}}``."""
    scores = {}
    for field, weight in weights.items():
        texts = {d: f[field] for d, f in docs.items() if f.get(field)}
        if not texts:
            continue
        average = sum(map(len, texts.values())) / len(texts)
        for term in query.split():
            df = sum(term in t for t in texts.values())
            for d, t in texts.items():
                tf = t.count(term)
                if tf:
                    idf = math.log(1 + (len(texts) - df + 0.5) / (df + 0.5))
                    part = weight * idf * tf / (tf + k1 * (1 - b + b * len(t) / average))
                    scores.setdefault(d, {}).setdefault(field, 0.0)
                    scores[d][field] += part
    best = {d: round(max(f.values()), 6) for d, f in scores.items()}
    return sorted(best.items(), key=lambda x: (-x[1], x[0]))


def random_docs(spark, count, seed):
    rng = random.Random(seed)
    vocabulary = [f"{c}{i:05d}x" for i, c in enumerate("abcdefghijklmnopqrstuvwxyz" * 4)]
    docs = {}
    for n in range(count):
        size = rng.randint(0, 30)
        # "zz" is in almost every document, so it is a very frequent term.
        body = [rng.choice(vocabulary) for _ in range(size)] + ["zz"] * rng.randint(0, 3)
        docs[f"d{n:04d}"] = {"title": rng.sample(vocabulary, 3), "synopsis": body}
    rows = [(d, " ".join(f["title"]), " ".join(f["synopsis"])) for d, f in docs.items()]
    df = normalize(spark.createDataFrame(rows, "book_id string, title string, synopsis string"))
    asked = {f"q{i}": " ".join(rng.choices(vocabulary, k=4) + ["zz"] * rng.randint(0, 2)) for i in range(12)}
    asked["only"] = "zz"
    asked["none"] = "unknown"
    return docs, df, asked


WEIGHTS = {"title": 2.0, "synopsis": 1.0}


@pytest.mark.parametrize("depth", [3, 200])
@pytest.mark.parametrize("broadcast_rows", [2_000_000, 0])
def test_bm25_matches_brute_force(spark, depth, broadcast_rows):
    docs, df, asked = random_docs(spark, 150, depth)
    cfg = RetrievalConfig(
        field_weights=WEIGHTS, mapping_boosts={}, keyword_fields=(), fuzzy=False,
        broadcast_rows=broadcast_rows, join_salts=4)
    lexical = bulk_index(df, HashingEmbedder(), cfg).lexical
    got = as_lists(bm25_top(queries_of(spark, **asked), lexical, cfg, depth))
    for name, text in asked.items():
        want = brute_bm25(docs, text, WEIGHTS)[:depth]
        have = got.get(name, [])
        assert [d for d, _ in have] == [d for d, _ in want], name
        assert np.allclose([s for _, s in have], [s for _, s in want], atol=2e-6)


def test_repeated_query_terms_count_twice(spark, index):
    cfg = RetrievalConfig(fuzzy=False, field_weights={"synopsis": 1.0}, mapping_boosts={})
    got = as_lists(bm25_top(queries_of(spark, once="garden", twice="garden garden"), index.lexical, cfg))
    assert got["twice"][0][1] == pytest.approx(2 * got["once"][0][1], abs=2e-6)


def test_keyword_field_compares_the_whole_query(spark, index):
    cfg = RetrievalConfig(fuzzy=False, field_weights={"genres": 1.5}, mapping_boosts={})
    got = as_lists(bm25_top(
        queries_of(spark, exact="Nature", lower="nature", part="Nature walks"), index.lexical, cfg))
    assert [d for d, _ in got["exact"]] == ["2", "3"]
    assert "lower" not in got and "part" not in got


def test_fuzzy_finds_swapped_letters(spark, index):
    asked = queries_of(spark, typo="sofwtare", far="sxfxwxre")
    fuzzy = as_lists(bm25_top(asked, index.lexical, RetrievalConfig()))
    plain = as_lists(bm25_top(asked, index.lexical, RetrievalConfig(fuzzy=False)))
    assert {d for d, _ in fuzzy["typo"]} == {"1", "3"}
    assert "far" not in fuzzy and plain == {}


def test_scoring_plan_has_one_shuffle(spark, index):
    top = bm25_top(queries_of(spark, a="software garden"), index.lexical, RetrievalConfig())
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "WindowGroupLimit" in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def scans_of(df, label):
    """Scans of a stored table in the plan that has run."""
    seen, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if "QueryStage" in name:
            todo.append(node.plan())
            continue
        if name.startswith("Scan parquet") and label in node.toString():
            seen.append(node)
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return seen


def files_read(spark, df, label):
    """Files that scans of a stored table have read, by the metrics of the run."""
    df.collect()
    return [scan.metrics().apply("numFiles").value() for scan in scans_of(df, label)]


def test_a_short_query_reads_the_folders_of_its_terms(spark, index):
    cfg = RetrievalConfig(fuzzy=False)
    weights = store(query_weights(queries_of(spark, a="garden software birds"), index.lexical, cfg), "weights")
    scores = bm25_scores(weights, index.lexical, cfg)
    (scan,) = [line for line in scores._jdf.queryExecution().toString().splitlines()
               if "FileScan parquet" in line and "postings" in line][-1:]
    assert "dynamicpruning" in scan.split("PartitionFilters")[1]
    folders = weights.df.select("term_part").distinct().count()
    assert folders <= 3 and scores.count() > 0


def test_a_short_query_reads_few_postings(spark):
    cfg, (_, docs, _) = RetrievalConfig(
        fuzzy=False, keyword_fields=(), field_weights=WEIGHTS, mapping_boosts={}, index_buckets=2), random_docs(spark, 200, 4)
    index = bulk_index(docs, HashingEmbedder(), cfg)
    words = [r["term"] for r in index.lexical.term_stats.select("term").distinct().orderBy("term").limit(2).collect()]
    weights = store(query_weights(queries_of(spark, a=" ".join(words)), index.lexical, cfg), "weights")
    scores = bm25_scores(weights, index.lexical, cfg)
    whole = index.lexical.parts[0]
    (some,), (every,) = files_read(spark, scores, "postings"), files_read(spark, whole, "postings")
    assert 0 < some <= 2 * len(words) and every > some


def test_a_short_query_reads_some_fuzzy_keys_only(spark, index):
    wanted = store(spark.createDataFrame([("text", "brids")], "kind string, q_term string"), "wanted")
    pairs = similar_terms(wanted.df, index.lexical.keys, RetrievalConfig(), wanted.rows)
    assert {r["term"] for r in pairs.collect()} == {"birds"}
    (some,), (every,) = files_read(spark, pairs, "fuzzy-keys"), files_read(spark, index.lexical.keys, "fuzzy-keys")
    assert 0 < some < every / 3


def test_a_page_of_documents_reads_their_buckets(spark):
    cfg = RetrievalConfig(keyword_fields=(), field_weights=WEIGHTS, mapping_boosts={}, index_buckets=12)
    _, docs, _ = random_docs(spark, 200, 5)
    index = bulk_index(docs, HashingEmbedder(), cfg)
    some = [r["doc_id"] for r in index.corpus.select("doc_id").orderBy("doc_id").limit(2).collect()]
    ids = store(spark.createDataFrame([(i,) for i in some], "doc_id string"), "ids")
    want = sorted(index.corpus.where(F.col("doc_id").isin(some)).collect())
    for settings in ({}, {"lookup_rows": 0}, {"lookup_rows": 0, "broadcast_rows": 0}):
        found = documents_named(index.corpus, ids, replace(cfg, **settings))
        assert sorted(found.collect()) == want and len(want) == 2
    found = documents_named(index.corpus, ids, cfg)
    found.collect()
    (scan,) = scans_of(found, "corpus")
    assert scan.optionalBucketSet().get().cardinality() <= 2


def test_changes_do_not_read_postings(spark):
    cfg = RetrievalConfig(keyword_fields=(), field_weights=WEIGHTS, mapping_boosts={}, index_buckets=2)
    _, docs, _ = random_docs(spark, 60, 6)
    index = bulk_index(docs, HashingEmbedder(), cfg)
    hidden = replace(index, lexical=replace(index.lexical, parts=(index.lexical.parts[0].where(
        F.raise_error(F.lit("postings were read")).isNull()),)))
    changed = apply_changes(hidden, docs.limit(5), cfg)
    want = sorted(bulk_index(docs, HashingEmbedder(), cfg).lexical.term_stats.collect())
    assert sorted(changed.lexical.term_stats.collect()) == want


@pytest.mark.parametrize("n", [0, 1, 137, 499, 500, 900])
def test_first_rows_of_ranges(spark, monkeypatch, n):
    df = spark.range(500, numPartitions=6).select((F.col("id") * 7919 % 500).alias("a"), F.lit("x").alias("_range_"))
    want = [(i, "x") for i in range(499, 499 - min(n, 500), -1)]
    monkeypatch.setattr(topk, "SELECTED_ROWS", -1)
    got = topk.first_n(df, [F.desc("a")], n)
    assert sorted(map(tuple, got.collect()), reverse=True) == want and got.columns == df.columns
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.replace("_cut", "") or "TakeOrdered" not in plan


def test_long_texts_weigh_more_than_their_rows(spark):
    rows = spark.createDataFrame([("x" * 3200,), ("y",)], "t string")
    assert store(rows, "texts").weight == 2
    assert store(rows, "texts", totals={"chars": F.sum(F.length("t"))}).weight == 200
    assert store(rows.limit(0), "texts", totals={"chars": F.sum(F.length("t"))}).weight == 0


def test_top_k_is_the_same_for_any_merge_width(spark):
    df = spark.range(2000, numPartitions=7).select(
        (F.col("id") % 3).alias("g"), (F.hash("id") % 50).alias("s"), "id")
    order = [F.desc("s"), F.asc("id")]
    narrow, wide = (sorted(map(tuple, top_k(df, ["g"], order, 9, width=w).collect())) for w in (1, 5))
    assert narrow == wide and len(narrow) == 27


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    rows = df.select(l2_norm(F.col("v")), l2_normalize(F.col("v")), dot(F.col("v"), F.col("v"))).collect()
    assert tuple(rows[0]) == (5.0, [0.6, 0.8], 25.0)
    assert tuple(rows[1]) == (0.0, [0.0, 0.0], 0.0)


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(400, 8))
    data[100:240] = data[100]  # a third of the vectors are copies
    data /= np.linalg.norm(data, axis=1, keepdims=True)
    data = data.astype("float32")
    rows = [(f"v{i:03d}", [float(x) for x in v]) for i, v in enumerate(data)]
    vectors = spark.createDataFrame(rows, "doc_id string, vector array<float>").repartition(5)
    queries = spark.createDataFrame(
        [(f"q{i}", rows[i * 37][1]) for i in range(10)], "query_id string, vector array<float>")
    return data.astype("float64"), vectors, queries


def brute_neighbours(data, k):
    out = {}
    for i in range(10):
        scores = np.round(data @ data[i * 37], 6)
        order = sorted(range(len(data)), key=lambda n: (-scores[n], f"v{n:03d}"))[:k]
        out[f"q{i}"] = [(f"v{n:03d}", pytest.approx(scores[n], abs=1e-9)) for n in order]
    return out


@pytest.mark.parametrize("k, block", [(5, 4096), (150, 4096), (1000, 4096), (7, 3)])
def test_exact_neighbours(spark, cloud, k, block):
    data, vectors, queries = cloud
    cfg = RetrievalConfig(query_block_rows=block)
    got = as_lists(knn_exact(queries, vectors, cfg, k))
    assert got == brute_neighbours(data, k)


def test_exact_neighbours_are_one_job_for_any_number_of_queries(spark, cloud):
    _, vectors, queries = cloud
    small = knn_exact(queries, vectors, RetrievalConfig(query_block_rows=2, slice_rows=40), 5)
    plan = small._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapCoGroupsInArrow") == 1 and "Union" not in plan and "Cartesian" not in plan
    assert as_lists(small) == as_lists(knn_exact(queries, vectors, RetrievalConfig(), 5))


def test_hashed_neighbours(spark, cloud):
    data, vectors, queries = cloud
    wide = knn_lsh(queries, vectors, RetrievalConfig(), 10, bucket_length=50.0, tables=30)
    assert as_lists(wide) == brute_neighbours(data, 10)
    near = as_lists(knn_lsh(queries, vectors, RetrievalConfig(), 400, bucket_length=50.0, tables=30, least=0.5))
    exact = as_lists(knn_exact(queries, vectors, RetrievalConfig(), 400))
    assert near == {q: [(d, s) for d, s in rows if s >= 0.5] for q, rows in exact.items()}
    some = as_lists(knn_lsh(queries, vectors, RetrievalConfig(), 10, bucket_length=0.3, tables=6))
    assert all(dict(exact[q])[d] == s for q, rows in some.items() for d, s in rows)


def test_vectors_that_are_missing_are_never_found(spark, cloud):
    _, vectors, queries = cloud
    holes = vectors.withColumn("vector", F.when(F.col("doc_id") != "v000", F.col("vector")))
    found = knn_exact(queries, holes, RetrievalConfig(), 1000)
    assert found.where(F.col("doc_id") == "v000").isEmpty()
    assert found.groupBy("query_id").count().select("count").distinct().collect()[0][0] == 399


@pytest.mark.parametrize("slice_rows, block, depth", [(20_000, 4096, 10), (30, 4096, 150), (7, 3, 1000)])
def test_cells_in_slices_lose_no_neighbour(spark, cloud, slice_rows, block, depth):
    data, vectors, queries = cloud
    cells = build_cells(vectors, 4, slice_rows=slice_rows)
    # The copies are in one cell, which is cut by document and not by vector.
    most = max(r["slices"] for r in cells.slices.collect())
    assert most >= 140 // slice_rows
    cfg = RetrievalConfig(query_block_rows=block)
    assert as_lists(knn_approx(queries, cells, cfg, probes=4, depth=depth)) == brute_neighbours(data, depth)


def test_approximate_search_reads_probed_cells_only(spark, cloud):
    _, vectors, queries = cloud
    cells = build_cells(vectors, 6)
    plan = knn_approx(queries.limit(1), cells, RetrievalConfig(), probes=1)._jdf.queryExecution().toString()
    read = [line for line in plan.splitlines() if "FileScan parquet" in line and "cells" in line]
    assert any("PartitionFilters" in line and "cell" in line.split("PartitionFilters")[1] for line in read)


def test_no_query_and_no_vector_give_no_neighbour(spark, cloud):
    _, vectors, queries = cloud
    cells = build_cells(vectors, 2)
    assert knn_approx(queries.limit(0), cells, RetrievalConfig(), probes=2).isEmpty()
    nothing = build_cells(vectors.limit(0), centers=cells.centers)
    assert knn_approx(queries, nothing, RetrievalConfig(), probes=2).isEmpty()


def test_cells_find_a_subset_and_all_of_them_everything(spark, cloud):
    data, vectors, queries = cloud
    cells = build_cells(vectors, 6)
    assert cells.vectors.count() == 400
    full = as_lists(knn_approx(queries, cells, RetrievalConfig(), probes=6, depth=10))
    assert full == brute_neighbours(data, 10)
    some = as_lists(knn_approx(queries, cells, RetrievalConfig(), probes=2, depth=10))
    exact = {q: dict(rows) for q, rows in as_lists(knn_exact(queries, vectors, RetrievalConfig(), 400)).items()}
    hits = 0
    for q, rows in some.items():
        assert all(exact[q][d] == s for d, s in rows)
        hits += len({d for d, _ in rows} & {d for d, _ in full[q]})
    assert hits >= 50


def test_given_centres_are_kept(spark, cloud):
    data, vectors, queries = cloud
    centers = [list(map(float, r["vector"])) for r in vectors.orderBy("doc_id").limit(3).collect()]
    cells = build_cells(vectors, centers=centers)
    assert cells.centers == centers and cells.vectors.count() == 400
    assert as_lists(knn_approx(queries, cells, RetrievalConfig(), probes=3, depth=10)) == brute_neighbours(data, 10)


def test_hashing_embedder_is_unit_length(spark):
    df = spark.createDataFrame([("one two two",), ("",)], "t string")
    rows = df.select(HashingEmbedder(16).column(F.col("t")).alias("v")).collect()
    assert sum(x * x for x in rows[0]["v"]) == pytest.approx(1.0, abs=1e-6)
    assert rows[1]["v"] == [0.0] * 16


def test_model_plugins(spark):
    def load_embedder():
        return lambda texts, role: [[len(t), 3.0 if role == "query" else 4.0] for t in texts]

    df = spark.createDataFrame([("abc",)], "t string")
    model = ModelEmbedder("toy", 2, load_embedder)
    document, query = df.select(
        model.column(F.col("t"), "document"), model.column(F.col("t"), "query")).first()
    assert document == pytest.approx([0.6, 0.8]) and query == pytest.approx([2**-0.5] * 2)

    def load_scorer():
        def score(queries, passages):
            if any("boom" in p for p in passages):
                raise RuntimeError
            return [len(p) for p in passages]
        return score

    rows = spark.createDataFrame([("q", "t", "s"), ("q", "boom", "s")], "q string, t string, s string")
    scored = rows.repartition(2, "t").select(ModelScorer("toy", load_scorer).column(F.col("q"), F.col("t"), F.col("s")))
    assert {r[0] for r in scored.collect()} <= {4.0, None}


def test_bulk_counts_and_empty_fields(index):
    assert index.counts == {"indexed": 4, "failed": 0}
    row = index.corpus.where("doc_id = '3'").first()
    assert row["authors"] == ["Ann Martin"] and row["publisher"] == ""
    assert index.corpus.schema.fieldNames() == [f.name for f in schema.CORPUS]


@pytest.mark.parametrize("broadcast_rows", [2_000_000, 0])
def test_changed_index_equals_a_new_one(spark, broadcast_rows):
    cfg = RetrievalConfig(
        keyword_fields=(), field_weights=WEIGHTS, mapping_boosts={}, broadcast_rows=broadcast_rows, join_salts=3)
    _, first, asked = random_docs(spark, 120, 1)
    _, second, _ = random_docs(spark, 40, 2)
    # Half of the changes replace documents, the others are new.
    number = F.substring("doc_id", 2, 4).cast("int")
    change = second.withColumn("doc_id", F.concat(F.lit("d"), F.lpad(number + 100, 4, "0")))
    whole = first.join(change, "doc_id", "left_anti").unionByName(change)
    model = HashingEmbedder()
    updated = apply_changes(bulk_index(first, model, cfg), change, cfg)
    asked = requests(spark, [(q, text, 5, 0.0) for q, text in asked.items()])

    def state(index):
        return (
            sorted(index.lexical.term_stats.select("field", "term", "df").collect()),
            sorted(index.lexical.field_stats.select("field", "n_docs", "avgdl").collect()),
            sorted(hybrid_search(asked, index, cfg).collect()),
        )

    fresh = state(bulk_index(whole, model, cfg))
    assert state(updated) == fresh
    assert state(rebuild(updated, cfg)) == fresh


def test_search_in_cells_follows_changes_and_is_saved(spark, workdir):
    cfg = RetrievalConfig(keyword_fields=(), field_weights=WEIGHTS, mapping_boosts={}, probes=3)
    _, first, asked = random_docs(spark, 120, 1)
    _, second, _ = random_docs(spark, 40, 2)
    model = HashingEmbedder()
    whole = first.join(second, "doc_id", "left_anti").unionByName(second)
    asked = requests(spark, [(q, text, 5, 0.0) for q, text in asked.items()])
    # All cells are probed, so the result is the exact one.
    want = sorted(hybrid_search(asked, bulk_index(whole, model, cfg), replace(cfg, probes=None)).collect())
    changed = apply_changes(with_cells(bulk_index(first, model, cfg), 3), second, cfg)
    assert sorted(hybrid_search(asked, changed, cfg).collect()) == want
    save_index(changed, f"{workdir}/cells", cfg)
    opened, settings = open_index(spark, f"{workdir}/cells", model)
    assert settings == cfg
    assert sorted(hybrid_search(asked, opened, settings).collect()) == want
    with pytest.raises(ValueError):
        hybrid_search(asked, replace(opened, cells=None), cfg)


def requests(spark, rows):
    return spark.createDataFrame(rows, schema.QUERIES)


def test_requests_are_checked(spark):
    ok, bad = validate(requests(spark, [
        ("a", "x", None, None), ("b", "x", 0, 0.0), ("c", "x", 51, 0.0), ("d", "x", 50, 1.0),
        ("e", "x", 1, 1.5), ("f", None, 1, 0.0)]))
    assert {r["query_id"]: (r["limit"], r["threshold"]) for r in ok.collect()} == {
        "a": (5, 0.0), "d": (50, 1.0)}
    assert {r["query_id"] for r in bad.collect()} == {"b", "c", "e", "f"}


def test_search_end_to_end(spark, index):
    got = hybrid_search(requests(spark, [
        ("a", "software architecture", 2, 0.0), ("n", "zzzzzzzz", 3, 0.0),
        ("t", "software architecture", 3, 0.5)]), index, RetrievalConfig()).collect()
    by_query = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by_query.setdefault(r["query_id"], []).append(r["id"])
    assert by_query["a"][0] == "1" and len(by_query["a"]) == 2
    assert len(by_query["n"]) == 3  # neighbours always exist
    assert "t" not in by_query  # no fused score reaches 0.5


def test_failing_reranker_does_not_change_results(spark, index):
    def load():
        raise RuntimeError

    asked = requests(spark, [("a", "software garden", 4, 0.0)])
    plain = hybrid_search(asked, index, RetrievalConfig()).collect()
    broken = hybrid_search(asked, index, RetrievalConfig(), ModelScorer("broken", load)).collect()
    assert sorted(plain) == sorted(broken)


def test_results_are_remembered(spark, index, workdir):
    path = f"{workdir}/cache"
    spark.createDataFrame([], schema.CACHE).write.parquet(path)
    asked = requests(spark, [("a", "software", 2, 0.0), ("b", "software", 2, 0.0), ("c", "birds", 2, 0.9)])

    def run(now):
        cache = spark.read.schema(schema.CACHE).parquet(path)
        rows = memoised_search(
            asked, index, RetrievalConfig(), cache, path, F.lit(now).cast("timestamp")).collect()
        return {r["query_id"]: (r["source"], [i["id"] for i in r["items"]]) for r in rows}

    first = run("2024-01-01 00:00:00")
    assert first["a"][0] == "search" and first["a"] == first["b"] and first["c"][1] == []
    again = run("2024-01-01 00:04:59")
    assert again["a"] == ("cache", first["a"][1]) and again["c"] == ("cache", [])
    assert run("2024-01-01 00:05:00")["a"][0] == "search"


def test_last_row_of_a_repeated_id_is_indexed(spark, corpus):
    again = corpus.withColumn("title", F.concat(F.lit("New "), F.col("title"))).withColumn("version", F.lit(2))
    both = corpus.withColumn("version", F.lit(1)).unionByName(again)
    nameless = both.limit(2).withColumn("doc_id", F.lit(""))
    found = bulk_index(both.union(both).unionByName(nameless), HashingEmbedder(), RetrievalConfig(), ["version"])
    once = bulk_index(again.drop("version"), HashingEmbedder(), RetrievalConfig())
    assert found.counts == {"indexed": 4, "failed": 2}
    assert sorted(found.corpus.collect()) == sorted(once.corpus.collect())
    stats = lambda index: sorted(index.lexical.term_stats.select("field", "term", "df").collect())
    assert stats(found) == stats(once)


def test_a_fuzzy_search_reads_stored_keys_only(spark, index):
    wanted = spark.createDataFrame([("text", "sofwtare")], "kind string, q_term string")
    pairs = similar_terms(wanted, index.lexical.keys, RetrievalConfig(), 1)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    # One generator for the keys of the query words, which also prune the folders, one for the
    # distance; none over the vocabulary.
    assert plan.count("Generate explode") == 3 and plan.count("dynamicpruning") == 1
    vocabulary = index.lexical.term_stats.where("field != 'genres'").withColumn("kind", F.lit("text"))
    found = expand_terms(wanted, vocabulary, index.lexical.keys, RetrievalConfig(), 1)
    assert {r["term"] for r in found.collect()} == {"software"}


@pytest.mark.parametrize("broadcast_rows", [2_000_000, 0])
def test_a_fuzzy_search_sums_the_changes_of_similar_terms_only(spark, broadcast_rows):
    cfg = RetrievalConfig(
        keyword_fields=(), field_weights=WEIGHTS, mapping_boosts={}, broadcast_rows=broadcast_rows)
    _, first, asked = random_docs(spark, 60, 1)
    _, second, _ = random_docs(spark, 20, 2)
    changed = apply_changes(bulk_index(first, HashingEmbedder(), cfg), second, cfg)
    words = [(w,) for w in next(iter(asked.values())).split()[:1]]
    wanted = spark.createDataFrame(words, "q_term string").withColumn("kind", F.lit("text"))
    rows_of_terms = changed.lexical.term_log.withColumn("kind", F.lit("text"))
    found = expand_terms(wanted, rows_of_terms, changed.lexical.keys, cfg, len(words))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # One sum, over the rows of similar terms in the stored statistics and in the signed rows.
    assert plan.count("sum(df") == 1 and plan.count("Join LeftSemi") == 2
    assert plan.index("sum(df") < plan.index("Join LeftSemi")
    assert ("strategy=broadcast" in plan) == (broadcast_rows > 0)
    df = {(r["field"], r["term"]): r["df"] for r in changed.lexical.term_stats.collect()}
    rows = found.collect()
    assert rows and all(df[r["field"], r["term"]] == r["df"] for r in rows)
    near = {(r["kind"], r["q_term"], r["term"]) for r in similar_terms(wanted, changed.lexical.keys, cfg, 1).collect()}
    assert {(r["q_term"], r["field"], r["term"]) for r in rows} == {
        (q, field, term) for _, q, term in near for field in WEIGHTS if (field, term) in df}


def test_saved_index_opens_in_another_session(spark, index, workdir):
    cfg = RetrievalConfig(k1=1.1)
    asked = requests(spark, [("a", "software garden", 3, 0.0), ("b", "brids", 2, 0.0)])
    want = sorted(hybrid_search(asked, index, cfg).collect())
    save_index(index, f"{workdir}/books", RetrievalConfig())
    save_index(index, f"{workdir}/books", cfg)
    other = spark.newSession()
    opened, settings = open_index(other, f"{workdir}/books", HashingEmbedder())
    again = other.createDataFrame(asked.collect(), schema.QUERIES)
    assert settings == cfg and opened.counts == index.counts
    assert sorted(hybrid_search(again, opened, settings).collect()) == want
    with pytest.raises(FileNotFoundError):
        open_index(spark, f"{workdir}/nothing", HashingEmbedder())
    with pytest.raises(ValueError):
        open_index(spark, f"{workdir}/books", HashingEmbedder(2))


def test_few_queries_are_scored_where_the_documents_are(spark):
    cfg = RetrievalConfig(fuzzy=False, keyword_fields=(), field_weights=WEIGHTS, mapping_boosts={}, index_buckets=3)
    _, docs, _ = random_docs(spark, 300, 8)
    index = bulk_index(docs, HashingEmbedder(), cfg)
    words = [r["term"] for r in index.lexical.term_stats.select("term").distinct().orderBy("term").collect()]
    queries = queries_of(spark, **{f"q{i}": " ".join(words[i : i + 1 + i % 9]) for i in range(60)})
    many = replace(cfg, broadcast_rows=0)
    for depth in (1, 7, 400):
        few = bm25_top(queries, index.lexical, cfg, depth)
        assert sorted(few.collect()) == sorted(bm25_top(queries, index.lexical, many, depth).collect())
    # A posting is read once for all queries instead of once for each, and never moved.
    assert "MapInArrow" in few._jdf.queryExecution().executedPlan().toString()
    nearest = knn_exact(
        queries.select("query_id", HashingEmbedder().column(F.col("q")).alias("vector")), index.vectors, cfg, 7)
    assert "CoGroups" not in nearest._jdf.queryExecution().executedPlan().toString()
    grid = knn_exact(
        queries.select("query_id", HashingEmbedder().column(F.col("q")).alias("vector")), index.vectors,
        replace(cfg, query_block_rows=7), 7)
    assert sorted(nearest.collect()) == sorted(grid.collect())


def test_blocks_of_documents_do_not_change_the_scores(spark, monkeypatch):
    cfg = RetrievalConfig(fuzzy=False, keyword_fields=(), field_weights=WEIGHTS, mapping_boosts={}, index_buckets=2)
    _, docs, _ = random_docs(spark, 200, 9)
    index = bulk_index(docs, HashingEmbedder(), cfg)
    words = [r["term"] for r in index.lexical.term_stats.select("term").distinct().orderBy("term").limit(40).collect()]
    queries = queries_of(spark, a=" ".join(words), b=" ".join(words[:3]), c=words[0], d="unknownword")
    weights = store(query_weights(queries, index.lexical, cfg), "weights")
    want = sorted(top_k(bm25_scores(weights, index.lexical, cfg), ["query_id"], [F.desc("score"), F.asc("doc_id")], 5).collect())
    numbered = scoring.best_scored(index.lexical.parts, weights, cfg, 5)
    assert sorted(top_k(numbered, ["query_id"], [F.desc("score"), F.asc("doc_id")], 5).collect()) == want
    monkeypatch.setattr(scoring, "_PAIRS", 1)
    monkeypatch.setattr(scoring, "_KEPT", 4)
    small = scoring.best_scored(index.lexical.parts, weights, cfg, 5)
    assert sorted(top_k(small, ["query_id"], [F.desc("score"), F.asc("doc_id")], 5).collect()) == want


def test_ties_behind_the_last_kept_document_are_dropped_at_once(monkeypatch):
    class Shared:
        value = scoring._query_lists(pa.table({"_number": [0], "_place": [0], "query_id": ["q"], "weight": [1.0]}))

    kept, sorts, lexsort = scoring._best_of_task(Shared, 1, 3, 6), [], np.lexsort
    monkeypatch.setattr(scoring, "_KEPT", 400)
    monkeypatch.setattr(np, "lexsort", lambda keys: sorts.append(1) or lexsort(keys))
    ids = [f"{n:05d}" for n in range(4000)]
    shuffled = random.Random(3).sample(ids, len(ids))
    for documents in (ids, ids[::-1], shuffled):
        sorts.clear()
        kind = pa.list_(pa.struct([("_number", pa.int64()), ("share", pa.float64())]))
        batches = [
            pa.RecordBatch.from_pydict({
                "doc_id": pa.array(documents[at : at + 200]),
                "found": pa.array([[{"_number": 0, "share": 0.5}]] * 200, kind)})
            for at in range(0, len(documents), 200)]
        found = [row["doc_id"] for batch in kept(iter(batches)) for row in batch.to_pylist()]
        assert sorted(found)[:3] == ids[:3]
        if documents is ids:
            assert len(sorts) == 2  # the first rows, and what is left at the end


def test_buckets_grow_with_the_input_and_are_written_one_by_one(spark, monkeypatch, workdir):
    _, docs, _ = random_docs(spark, 300, 7)
    docs.write.parquet(f"{workdir}/docs")
    docs, cfg = spark.read.parquet(f"{workdir}/docs"), RetrievalConfig(
        keyword_fields=(), field_weights=WEIGHTS, mapping_boosts={}, term_partitions=2, key_partitions=2)
    size = sum(os.path.getsize(f) for f in glob.glob(f"{workdir}/docs/*.parquet"))
    assert bucket_count(spark, None, docs) == bucket_count(spark) == bucket_count(spark, None, docs.limit(0))
    small = bulk_index(docs, HashingEmbedder(), cfg)
    monkeypatch.setattr(workspace, "_BUCKET_BYTES", size // 20)
    assert bucket_count(spark, None, docs) == -(-size // (size // 20)) and bucket_count(spark, 3, docs) == 3
    large = bulk_index(docs, HashingEmbedder(), cfg)
    save_index(large, f"{workdir}/saved", cfg)
    opened, _ = open_index(spark, f"{workdir}/saved", HashingEmbedder())
    assert large.buckets == opened.buckets >= 20 > small.buckets
    for index in (large, opened):
        assert sorted(index.lexical.parts[0].collect()) == sorted(small.lexical.parts[0].collect())
        files = [f.rsplit("/", 2)[1:] for f in index.lexical.parts[0].inputFiles()]
        # One file for each bucket and folder, as a task has one bucket.
        assert len({(folder, name.split("_")[-1]) for folder, name in files}) == len(files)
        assert len({name.split("_")[-1] for _, name in files}) > small.buckets
