"""Documents from normalised relations, their clean-up, and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quillrank import schema
from quillrank.config import RetrievalConfig
from quillrank.functions.embedders import DOCUMENT, Embedder
from quillrank.functions.text import build_text, clean_list, first_non_empty
from quillrank.sources.workspace import Stored, bucket_count, store_bucketed


def assemble(
    book: DataFrame, publisher: DataFrame, author: DataFrame, genre: DataFrame,
    authored_by: DataFrame, having_genre: DataFrame,
) -> DataFrame:
    """One row per published book with its authors and genres.

    Each bridge is reduced to one row per book before the join, so authors and
    genres never multiply. Books without a publisher are left out. All sides are dealt
    by the text of the book's id into the parts that an index of these tables has, so a
    job that wants documents by id need not move them again.
    """
    parts = bucket_count(book.sparkSession, None, book, publisher, author, genre, authored_by, having_genre)
    key, kind = F.col("id").cast("string"), book.schema["id"].dataType

    def names_per_book(bridge: DataFrame, names: DataFrame, fk: str, name: str, out: str) -> DataFrame:
        rows = bridge.join(names.select(F.col("id").alias(fk), name), fk, "left")
        named = rows.select(F.col("id_book").cast(kind).cast("string").alias("_book"), name)
        return named.repartition(parts, "_book").groupBy("_book").agg(F.sort_array(F.collect_set(name)).alias(out))

    authors = names_per_book(authored_by, author, "id_author", "name", "authors")
    genres = names_per_book(having_genre, genre, "id_genre", "genre", "genres")
    publishers = publisher.select(F.col("id").alias("id_publisher"), F.col("name").alias("publisher"))
    return (
        book.join(publishers, "id_publisher").repartition(parts, key)
        .join(authors, key == authors["_book"], "left").drop("_book")
        .join(genres, key == genres["_book"], "left").drop("_book")
        .select(F.col("id").alias("book_id"), "title", "synopsis", "book_picture", "publisher",
                "authors", "genres")
    )


def assemble_fanout(
    book: DataFrame, publisher: DataFrame, author: DataFrame, genre: DataFrame,
    authored_by: DataFrame, having_genre: DataFrame,
) -> DataFrame:
    """The same result from the plain chain of joins, to compare with ``assemble``.

    Every author meets every genre of its book before duplicates are removed. The joins
    with the names come first and both bridges are dealt by book, so that these many rows
    are made, sorted and reduced in the tasks of their books and never move. The parts
    grow with the input, so that a task sorts what one part makes of it.
    """
    parts = bucket_count(book.sparkSession, None, book, authored_by, having_genre)

    def named(bridge: DataFrame, names: DataFrame, fk: str, name: str, out: str) -> DataFrame:
        known = names.select(F.col("id").alias(fk), F.col(name).alias(out))
        return bridge.join(known, fk, "left").select(F.col("id_book").alias("id"), out).repartition(parts, "id")

    authors = named(authored_by, author, "id_author", "name", "author")
    genres = named(having_genre, genre, "id_genre", "genre", "genre")
    ids = book.select("id").distinct().repartition(parts, "id")
    met = ids.join(authors, "id", "left").join(genres, "id", "left").groupBy("id").agg(
        F.sort_array(F.collect_set("author")).alias("authors"), F.sort_array(F.collect_set("genre")).alias("genres"))
    p = publisher.select(F.col("id").alias("id_publisher"), F.col("name").alias("publisher"))
    columns = [F.col("id").alias("book_id"), "title", "synopsis", "book_picture", "publisher"]
    books = book.join(p, "id_publisher").select("id", *columns[1:]).repartition(parts, "id").distinct()
    none = F.array().cast("array<string>")
    return books.join(met, "id", "left").select(
        *columns, F.coalesce("authors", none).alias("authors"), F.coalesce("genres", none).alias("genres"))


def normalize(rows: DataFrame) -> DataFrame:
    """Assembled or single documents in the shape of the corpus, without vector.

    Missing optional columns are allowed. The picture may come under either of
    its two names.
    """

    def column(name: str, kind: str) -> Column:
        return F.col(name) if name in rows.columns else F.lit(None).cast(kind)

    return rows.select(
        F.col("book_id").cast("string").alias("doc_id"),
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("synopsis", F.lit("")).alias("synopsis"),
        clean_list(column("authors", "array<string>")).alias("authors"),
        clean_list(column("genres", "array<string>")).alias("genres"),
        F.coalesce(column("publisher", "string"), F.lit("")).alias("publisher"),
        first_non_empty(column("book_picture", "string"), column("bookPicture", "string"))
        .alias("book_picture"),
    )


def spread(documents: DataFrame, parts: int) -> DataFrame:
    """Move every document to the part of its id.

    Embedding costs far more than moving a text, so it should not depend on how
    the input files happened to be cut.
    """
    return documents.repartition(parts, "doc_id")


def embed(documents: DataFrame, embedder: Embedder) -> DataFrame:
    """Add the vector of every document; it is a column, so rows cannot get mixed up."""
    text = build_text(F.col("title"), F.col("synopsis"))
    return documents.withColumn("vector", embedder.column(text, DOCUMENT))


def is_indexable(dim: int) -> Column:
    """Documents that can be stored: they have an id and a vector of the right length."""
    return F.coalesce(
        (F.col("doc_id") != "") & (F.size("vector") == dim), F.lit(False)
    )


def _counted(documents: DataFrame, dim: int) -> tuple[DataFrame, Observation]:
    """The indexable rows, and counts of both kinds taken while they pass."""
    seen = Observation()
    flagged = documents.withColumn("_ok", is_indexable(dim)).observe(
        seen, F.count_if("_ok").alias("indexed"), F.count_if(~F.col("_ok")).alias("failed")
    )
    return flagged.where("_ok").select([f.name for f in schema.CORPUS]), seen


def write_corpus(documents: DataFrame, path: str, dim: int, mode: str = "overwrite") -> dict[str, int]:
    """Store the indexable documents as plain files and count both kinds."""
    indexable, seen = _counted(documents, dim)
    indexable.write.mode(mode).parquet(path)
    return dict(seen.get)


def store_corpus(documents: DataFrame, dim: int, buckets: int) -> tuple[DataFrame, dict[str, int]]:
    """Store the indexable documents in buckets by id, for indexing and lookup."""
    indexable, seen = _counted(documents, dim)
    # Look-ups of a few ids skip buckets by their number and row groups by these filters.
    writer = indexable.write.options(**{
        "parquet.bloom.filter.enabled#doc_id": "true", "parquet.bloom.filter.adaptive.enabled": "true"})
    table = store_bucketed(writer, documents.sparkSession, "corpus", buckets, ["doc_id"])
    return table, dict(seen.get)


def documents_named(corpus: DataFrame, ids: Stored, cfg: RetrievalConfig) -> DataFrame:
    """The documents with the stored ids, which are distinct.

    A few ids are named to the scan, which then reads their buckets only. More are copied
    to the tasks that scan the corpus, very many are joined with it.
    """
    if ids.rows <= cfg.lookup_rows:
        return corpus.where(F.col("doc_id").isin([r["doc_id"] for r in ids.df.select("doc_id").collect()]))
    wanted = ids.df.select("doc_id")
    return corpus.join(F.broadcast(wanted) if ids.weight <= cfg.broadcast_rows else wanted, "doc_id", "left_semi")


def latest(versions: DataFrame, key: str, order: list[str], mode: str = "replace") -> DataFrame:
    """The last version of every document.

    ``replace`` takes the newest row as a whole. ``patch`` keeps, column by
    column, the newest value that is neither NULL nor empty. Each task reduces
    its rows to one per key first, so a key with very many versions is harmless.
    """
    position = F.struct(*order)
    columns = [c for c in versions.columns if c != key]
    if mode == "replace":
        newest = versions.groupBy(key).agg(F.max_by(F.struct(*columns), position).alias("_row"))
        return newest.select(key, "_row.*")
    if mode != "patch":
        raise ValueError(f"unknown mode {mode!r}")

    def patched(name: str) -> Column:
        kind = versions.schema[name].dataType.typeName()
        value = F.col(name)
        present = {"string": value != "", "array": F.size(value) > 0}.get(kind, value.isNotNull())
        return F.coalesce(
            F.max_by(value, F.when(present, position)), F.max_by(value, position)
        ).alias(name)

    return versions.groupBy(key).agg(*[patched(c) for c in columns])
