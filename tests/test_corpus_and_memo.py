import time

from pyspark.sql import functions as F

from quillrank import HashingEmbedder, schema
from quillrank.functions.keys import embedding_key
from quillrank.operators import memo
from quillrank.operators.corpus import assemble, assemble_fanout, latest, normalize, write_corpus
from quillrank.operators.corpus import embed, spread
from quillrank.sources.tables import (
    create_corpus_if_absent, read_corpus, read_query_set, scan_corpus, write_query_set,
)
from quillrank.sources.workspace import bucket_count, store


def at(text):
    return F.lit(text).cast("timestamp")


def test_assembly_keeps_books_without_authors_and_drops_those_without_publisher(spark):
    make = spark.createDataFrame
    relations = dict(
        book=make([(1, "A", "a", None, 7), (2, "B", None, "p", 7), (3, "C", "c", "", 9)],
                  "id long, title string, synopsis string, book_picture string, id_publisher long"),
        publisher=make([(7, "P")], "id long, name string"),
        author=make([(1, "Zoe"), (2, "Al"), (3, None)], "id long, name string"),
        genre=make([(1, "G"), (2, "")], "id long, genre string"),
        authored_by=make([(1, 1), (1, 2), (1, 2), (1, 3)], "id_book long, id_author long"),
        having_genre=make([(1, 1), (1, 2), (1, 9)], "id_book long, id_genre long"),
    )
    for build in (assemble, assemble_fanout):
        rows = {r["doc_id"]: r for r in normalize(build(**relations)).collect()}
        assert set(rows) == {"1", "2"}
        assert rows["1"]["authors"] == ["Al", "Zoe"] and rows["1"]["genres"] == ["G"]
        assert rows["2"]["authors"] == [] and rows["2"]["synopsis"] == ""
        assert rows["2"]["book_picture"] == "p" and rows["1"]["book_picture"] == ""


def test_rows_of_authors_and_genres_never_move(spark):
    make = spark.createDataFrame
    relations = dict(
        book=make([(1, "A", 7), (1, "A", 7), (1, "B", 7), (2, "C", 7), (3, "D", 9), (None, "E", 7)],
                  "id long, title string, id_publisher long")
        .withColumn("synopsis", F.lit("s")).withColumn("book_picture", F.lit(None).cast("string")),
        publisher=make([(7, "P")], "id long, name string"),
        author=make([(n, f"a{n}") for n in range(30)], "id long, name string"),
        genre=make([(n, f"g{n}") for n in range(30)], "id long, genre string"),
        authored_by=make([(1, n) for n in range(30)] + [(None, 1), (8, 2), (3, 2)], "id_book long, id_author long"),
        having_genre=make([(1, n) for n in range(20)] + [(2, 4), (2, None), (None, 1)], "id_book long, id_genre long"),
    )
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = assemble_fanout(**relations)
        lines = made._jdf.queryExecution().executedPlan().toString().split("\n")
        found = sorted((r["book_id"] or 0, r["title"], r["authors"], r["genres"]) for r in made.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    all_a, all_g = sorted(f"a{n}" for n in range(30)), sorted(f"g{n}" for n in range(20))
    assert found == [(0, "E", [], []), (1, "A", all_a, all_g), (1, "B", all_a, all_g), (2, "C", [], ["g4"])]
    depth = [len(line) - len(line.lstrip(" :+-")) for line in lines]
    for i, line in enumerate(lines):
        if "Exchange hashpartitioning" in line:
            end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            below = "\n".join(lines[i:end])
            assert not ("id_author" in below and "id_genre" in below)


def test_assembled_documents_are_where_an_index_wants_them(spark):
    make = spark.createDataFrame
    relations = dict(
        book=make([(n, f"T{n}", "s", None, n % 3) for n in range(40)],
                  "id long, title string, synopsis string, book_picture string, id_publisher long"),
        publisher=make([(n, f"P{n}") for n in range(3)], "id long, name string"),
        author=make([(n, f"a{n}") for n in range(5)], "id long, name string"),
        genre=make([(n, f"g{n}") for n in range(5)], "id long, genre string"),
        authored_by=make([(n, n % 5) for n in range(40)], "id_book long, id_author long"),
        having_genre=make([(n, n % 4) for n in range(40)], "id_book long, id_genre long"),
    )
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        documents = normalize(assemble(**relations))
        placed = spread(documents, bucket_count(spark, None, documents))
        moves = [df._jdf.queryExecution().executedPlan().toString().count("Exchange") for df in (documents, placed)]
        assert moves[0] == moves[1] and sorted(placed.collect()) == sorted(documents.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_shuffle_files_go_with_the_table_that_is_made_of_them(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return {name for name in disk.getAllFiles().mkString("\n").split("\n") if "shuffle_" in name}

    before = shuffled()
    rows = store(spark.range(10_000).repartition(7, "id"), "shuffled")
    until = time.time() + 20
    while shuffled() - before and time.time() < until:
        time.sleep(0.5)
    assert not shuffled() - before and rows.df.count() == rows.rows == 10_000


def test_latest_replaces_or_patches(spark):
    rows = spark.createDataFrame([
        ("x", "old", ["a"], "s", 1, 1), ("x", "new", [], "", 2, 2), ("y", "only", None, None, 1, 3),
    ], "doc_id string, title string, authors array<string>, synopsis string, ts int, n int")
    whole = {r["doc_id"]: r for r in latest(rows, "doc_id", ["ts", "n"]).collect()}
    assert (whole["x"]["title"], whole["x"]["authors"], whole["x"]["synopsis"]) == ("new", [], "")
    patched = {r["doc_id"]: r for r in latest(rows, "doc_id", ["ts", "n"], "patch").collect()}
    assert (patched["x"]["title"], patched["x"]["authors"], patched["x"]["synopsis"]) == ("new", ["a"], "s")
    assert patched["y"]["synopsis"] is None


def test_invalid_documents_are_counted_not_fatal(spark, workdir):
    docs = normalize(spark.createDataFrame(
        [("1", "t", "s"), (None, "t", "s"), ("", "t", "s")], "book_id string, title string, synopsis string"))
    counts = write_corpus(embed(docs, HashingEmbedder()), f"{workdir}/c", 384)
    assert counts == {"indexed": 1, "failed": 2}
    stored = read_corpus(spark, f"{workdir}/c")
    assert stored.count() == 1
    create_corpus_if_absent(spark, f"{workdir}/c")
    assert read_corpus(spark, f"{workdir}/c").count() == 1
    create_corpus_if_absent(spark, f"{workdir}/new")
    assert read_corpus(spark, f"{workdir}/new").isEmpty()


def test_scan_needs_id_and_title(spark):
    rows = spark.createDataFrame(
        [("2", "t", None), ("1", "t", "s"), (None, "t", "s"), ("3", "", "s")],
        "doc_id string, title string, synopsis string")
    assert sorted(r["doc_id"] for r in scan_corpus(rows).collect()) == ["1", "2"]
    assert [r["doc_id"] for r in scan_corpus(rows, 1).collect()] == ["1"]


def test_query_sets_round_trip(spark, workdir):
    qrels = spark.createDataFrame([("q é", "1", "keyword", "t")], schema.QRELS)
    write_query_set(qrels, f"{workdir}/q")
    saved = read_query_set(spark, f"{workdir}/q")
    assert saved.drop("query_id").collect() == qrels.collect() and saved.first()["query_id"]
    write_query_set(qrels.withColumn("query_id", F.lit("own")), f"{workdir}/named")
    assert [r["query_id"] for r in read_query_set(spark, f"{workdir}/named").collect()] == ["own"]
    with open(f"{workdir}/array.json", "w", encoding="utf-8") as out:
        out.write('[\n  {"query": "a", "relevant_id": "1", "style": "year", "title": "t"},\n'
                  '  {"query": "b", "relevant_id": "2", "style": "year", "title": "u"}\n]')
    assert read_query_set(spark, f"{workdir}/array.json", one_array=True).count() == 2


def test_cache_expiry_is_exact_and_newest_wins(spark):
    rows = spark.createDataFrame(
        [("k", "old", "2024-01-01 00:00:00"), ("k", "new", "2024-01-01 00:01:00"),
         ("later", "x", "2024-01-01 09:00:00")], "k string, v string, t string")
    cache = memo.entries(rows, F.col("k"), F.col("v"), F.col("t").cast("timestamp"), 300)
    asked = spark.createDataFrame([("k",), ("later",), ("none",)], "key string")

    def state(now):
        found = {r["key"]: r["payload"] for r in memo.lookup(asked, cache, at(now)).collect()}
        hit = {r["key"] for r in memo.hits(asked, cache, at(now)).collect()}
        miss = {r["key"] for r in memo.misses(asked, cache, at(now)).collect()}
        assert hit == set(found) and hit | miss == {"k", "later", "none"} and not hit & miss
        return found

    assert state("2024-01-01 00:00:30") == {"k": "old"}
    assert state("2024-01-01 00:05:59") == {"k": "new"}
    assert state("2024-01-01 00:06:00") == {}


def test_cache_keeps_entries_of_any_life(spark, workdir):
    rows = spark.createDataFrame(
        [("day", 86400, "2024-01-01 00:00:00"), ("short", 60, "2024-01-01 00:00:00"),
         ("replaced", 86400, "2024-01-01 00:00:00"), ("replaced", 60, "2024-01-01 01:00:00")], "k string, life int, t string")
    cache = memo.entries(rows, F.col("k"), F.col("k"), F.col("t").cast("timestamp"), F.col("life"))
    now = at("2024-01-01 05:00:00")
    assert [r["key"] for r in memo.live(cache, now).collect()] == ["day"]
    memo.purge(cache, f"{workdir}/purged", now)
    assert [r["key"] for r in spark.read.parquet(f"{workdir}/purged").collect()] == ["day"]


def test_lookups_read_the_hours_that_can_be_alive(spark, workdir):
    rows = spark.createDataFrame(
        [(f"k{i}", 3600 if i % 2 else 600, f"2024-01-01 {i:02d}:30:00") for i in range(20)]
        + [("k9", 60, "2024-01-01 10:10:00")], "k string, life int, t string")
    cache = memo.entries(rows, F.col("k"), F.col("k"), F.col("t").cast("timestamp"), F.col("life"))
    memo.append(cache, f"{workdir}/log")
    stored = spark.read.parquet(f"{workdir}/log")
    for now in ("2024-01-01 09:59:59", "2024-01-01 10:20:00", "2024-01-01 10:30:00", "2024-01-01 12:05:00"):
        whole = sorted(r["key"] for r in memo.live(cache, at(now)).collect())
        assert sorted(r["key"] for r in memo.live(stored, at(now), 3600).collect()) == whole
    # Replaced by an entry that is gone already.
    assert "k9" not in [r["key"] for r in memo.live(stored, at("2024-01-01 10:20:00"), 3600).collect()]
    recent = memo.written_within(stored, at("2024-01-01 10:20:00"), 3600)
    assert len(recent.inputFiles()) >= 20
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "written_hour" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert {r["written_hour"] % 24 for r in recent.select("written_hour").distinct().collect()} <= {9, 10}


def test_only_unknown_texts_are_embedded(spark):
    texts = spark.createDataFrame([("a",), ("b",), ("a",)], "text string")
    now = at("2024-01-01 00:00:00")
    cached = spark.createDataFrame([("a", "[1.0,0.0]")], "text string, payload string")
    cache = memo.entries(cached, embedding_key(F.col("text")), F.col("payload"), now, 3600)
    rows = {r["text"]: r for r in memo.memo_embeddings(texts, cache, HashingEmbedder(2), now).collect()}
    assert rows["a"]["source"] == "cache" and rows["a"]["vector"] == [1.0, 0.0]
    assert rows["b"]["source"] == "model" and len(rows) == 2
