"""A training-data pipeline over ``documents`` in five stages.

Each stage reads what the one before kept and returns the columns of documents;
the last returns what is encoded. Every stage is written as Parquet and read back, and
the tables it wrote on the way are removed then.

Defined results, the same in every stage: an empty table gives an empty one with the
same columns. Columns beside those of documents are kept as they are, whatever their
names; only the last stage returns its own. Rows without an id are documents of their
own with one id for all of them. Texts are taken whole, however long.

* language: null texts and texts without a letter are rejected; repeated rows all stay.
* near_duplicates: of repeated rows and of equal fingerprints one row stays, that of the
  smallest id, null last. Texts without words are near copies of each other.
* repeats: a null text is empty. A text cut down to white space goes with its row.
* mixture: documents without words go; repeated rows share one number of copies.
* encoded: a null or empty text has no ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillrank.llm.encoding import encode_documents
from quillrank.llm.language import fit_language, keep_identified
from quillrank.llm.mixing import take
from quillrank.llm.simhash import one_of_each
from quillrank.llm.suffixes import RepeatConfig, without_repeats
from quillrank.llm.tables import new_folder
from quillrank.sources.workspace import discard, scratch

#: Passages of more than 50 words have about 270 bytes or more.
PASSAGES = RepeatConfig(length=250)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those without a letter or a clear language go."""
    return keep_identified(docs, fit_language(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (fingerprints at two bits or less): the one with the smallest id."""
    return one_of_each(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 250 bytes or more that occur more than once."""
    return without_repeats(docs, PASSAGES)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return take(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, with the digests of ids and decoded text."""
    return encode_documents(docs, with_ids=True)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeats", repeats),
    ("mixture", mixture),
    ("encoded", encoded),
]

#: No stage can be stated in SQL: a learned classifier, trie join, suffix levels,
#: dynamic program and merge queue. Tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents of ``sf_dir``."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = new_folder(spark, f"pipeline-{name}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            discard(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
