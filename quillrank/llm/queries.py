"""The queries of this folder, each over its whole tables.

None has SQL: hashing by these functions, models, automata and dynamic programs
are not expressible there. Tests compare them with brute force instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.llm.codebooks import code_vectors
from quillrank.llm.encoding import encode_documents
from quillrank.llm.language import fit_language, identify_language
from quillrank.llm.licenses import scan_licenses
from quillrank.llm.mixing import mix
from quillrank.llm.neighbours import nearest
from quillrank.llm.packing import pack_documents
from quillrank.llm.quality import fit_quality, judge_quality
from quillrank.llm.simhash import near_duplicates
from quillrank.llm.spelling import group_variants
from quillrank.llm.suffixes import cut_repeats
from quillrank.llm.tokencount import count_tokens
from quillrank.llm.toxicity import fit_toxicity, score_toxicity


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Base rules and log-likelihood verdict of every document."""
    documents = _table(spark, sf, "documents")
    return judge_quality(documents, fit_quality(documents, _table(spark, sf, "labels")))


def op2_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """Toxicity score of every document, learned outside the held-out fold."""
    documents = _table(spark, sf, "documents")
    return score_toxicity(documents, fit_toxicity(documents, _table(spark, sf, "labels")))


def op3_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes of every document that lie in a repeated string of 400 bytes."""
    return cut_repeats(_table(spark, sf, "documents"))


def op4_simhash_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(_table(spark, sf, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_source_mix(spark: SparkSession, sf: str) -> DataFrame:
    """How often each document is taken by a mix with target weights for its source."""
    mixed = mix(_table(spark, sf, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op6_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Phrases and license templates in every document."""
    return scan_licenses(_table(spark, sf, "documents")).drop("spans")


def op7_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Exact token count of every document and whether it is over the limit."""
    return count_tokens(_table(spark, sf, "documents"))


def op8_language_id(spark: SparkSession, sf: str) -> DataFrame:
    """Language of every document, learned outside the held-out fold."""
    documents = _table(spark, sf, "documents")
    return identify_language(documents, fit_language(documents))


def op9_permutation_search(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 nearest vectors found for every twentieth vector."""
    return nearest(_table(spark, sf, "embeddings"))


def op10_bpe_codec(spark: SparkSession, sf: str) -> DataFrame:
    """Token ids of every document and what they decode to, as digests."""
    return encode_documents(_table(spark, sf, "documents"))


def op11_vector_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Product codes of every vector, with their errors and the digest of the codebooks."""
    coded = code_vectors(_table(spark, sf, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op12_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    """Place of every piece of every document in sequences of 1024 tokens."""
    return pack_documents(_table(spark, sf, "documents"))


def op13_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Near words, form and root of every word of the documents."""
    return group_variants(_table(spark, sf, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_quality_rules, op2_toxicity, op3_suffix_dedup, op4_simhash_near_duplicates,
        op5_source_mix, op6_license_scan, op7_token_counts, op8_language_id, op9_permutation_search,
        op10_bpe_codec, op11_vector_codes, op12_best_fit_packing, op13_spelling_variants,
    )
}
ORACLES: dict[str, str] = {}
