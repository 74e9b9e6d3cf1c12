"""Headline queries at ``$BENCH_SF_DIR``; prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from workloads import bindings
from workloads.queries import QUERIES

HEADLINE = [
    "assemble_documents",
    "embed_documents",
    "bm25_single_field",
    "bm25_multi_field",
    "bm25_multi_field_fuzzy",
    "fuzzy_expand",
    "knn_exact",
    "knn_exact_documents",
    "rrf_fuse",
    "rrf_ties",
    "threshold_after_limit",
    "rerank_head_tail",
    "hybrid_search",
    "hybrid_search_reranked",
    "eval_metrics_wide",
    "gen_queries_mixed",
    "cache_lookup",
    "memo_embeddings",
    "upsert_latest",
    "stream_upsert",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("quillrank-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="quillrank-wh-"))
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="quillrank-shared-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}

    def timed(name, run):
        start = time.perf_counter()
        run()
        seconds[name] = round(time.perf_counter() - start, 3)

    # Searches run against stored indexes, so building them is measured by itself.
    timed("build_document_index", lambda: bindings.document_index(spark, sf))
    timed("build_order_index", lambda: bindings.order_index(spark, sf))
    for name in HEADLINE:
        timed(name, lambda: QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save())
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
