"""The pipeline's stages, each judged on its own input."""

import re

import corpus_pipeline
import numpy as np
from quillrank.llm import simhash
from test_operators import SHARED, brute_fingerprint, docs, empty, rows_for_tests  # noqa: F401  fixtures

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages_in_order(spark, docs, tmp_path):  # noqa: F811
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "repeats", "mixture", "encoded"]
    at, before = docs, None
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, at, "").write.parquet(str(tmp_path / name))
        before, at = at, spark.read.parquet(str(tmp_path / name))
        if name != "encoded":
            assert at.columns == docs.columns
        rows, earlier = at.collect(), before.collect()
        if name == "language":
            kept = {r["doc_id"] for r in rows}
            assert not kept & {300, 301, 302, 303} and set(range(60)) <= kept
        if name == "near_duplicates":
            prints = [brute_fingerprint(r["text"]) for r in rows]
            assert all(bin(a ^ b).count("1") > 2 for i, a in enumerate(prints) for b in prints[:i])
            assert {r["text"] for r in rows} <= {r["text"] for r in earlier}
        if name == "repeats":
            before_ids = {r["doc_id"]: r["text"] for r in earlier}
            assert all(r["text"] == before_ids[r["doc_id"]] for r in rows if r["doc_id"] in range(60))
            assert not any(SHARED in (r["text"] or "") for r in rows)
        if name == "mixture":
            words = sum(len(SPACED.findall(r["text"])) for r in earlier)
            assert abs(sum(len(SPACED.findall(r["text"])) for r in rows) - 1.5 * words) < 0.02 * words + 60
        if name == "encoded":
            assert len(rows) == len(earlier) and all(len(r["ids"]) == r["n_tokens"] for r in rows)


def test_passages_of_over_fifty_words_are_cut(spark):
    rng = np.random.RandomState(12)
    word = lambda: "".join(rng.choice(list("abcdefghij"), rng.randint(3, 8)))
    passages = [" ".join(word() for _ in range(n)) for n in (51, 53, 56, 60)]
    short = " ".join(word() for _ in range(30))
    rows = []
    for i in range(60):
        own = [word() for _ in range(160)]
        planted = passages[i % 4] if i < 24 else short if i < 40 else ""
        rows.append((i, " ".join([*own[:80], planted, *own[80:]])))
    before = dict(rows)
    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.repeats(
        spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(5), "").collect()}
    for i in range(60):
        if i < 24:
            assert passages[i % 4][5:-5] not in kept[i] and len(kept[i]) > 0.6 * len(before[i])
        else:
            assert kept[i] == before[i]


def test_empty_table_and_run(spark, empty, tmp_path):  # noqa: F811
    at = empty
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, at, "").write.parquet(str(tmp_path / name))
        at = spark.read.schema(stage(spark, at, "").schema).parquet(str(tmp_path / name))
        assert at.count() == 0
    found = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"] and found.count() > 100
