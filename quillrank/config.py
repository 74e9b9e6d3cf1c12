"""Settings shared by every stage. All of them can be replaced per call."""

from __future__ import annotations

from dataclasses import dataclass, field

# Results depend on them, so they are stated here once.
FIELD_WEIGHTS = {
    "title": 3.0,
    "synopsis": 1.0,
    "authors": 2.0,
    "genres": 1.5,
    "publisher": 1.0,
}
MAPPING_BOOSTS = {"title": 2.0}
KEYWORD_FIELDS = ("genres",)
VECTOR_DIM = 384
RRF_K = 60
DEFAULT_LIMIT = 5
MIN_LIMIT = 1
MAX_LIMIT = 50
DEFAULT_THRESHOLD = 0.0
DEPTH_FACTOR = 4
MIN_DEPTH = 20
MAX_DEPTH = DEPTH_FACTOR * MAX_LIMIT
RERANK_TOP_K = 20
EMBEDDING_TTL_SECONDS = 3600
RESULTS_TTL_SECONDS = 300
ROUTING_KEY = "book.created"
EVAL_CUTOFFS = (1, 5, 10)
EVAL_METRIC_DEPTH = 10
EVAL_QUERY_COUNT = 100
STYLE_LABELS = {
    "keyword": "Title keywords",
    "author": "Author-based",
    "subject": "Subject/conceptual",
    "year": "Year + subject",
}


@dataclass(frozen=True)
class RetrievalConfig:
    """Scoring and sizing knobs of one search or indexing job."""

    field_weights: dict[str, float] = field(default_factory=lambda: dict(FIELD_WEIGHTS))
    mapping_boosts: dict[str, float] = field(default_factory=lambda: dict(MAPPING_BOOSTS))
    keyword_fields: tuple[str, ...] = KEYWORD_FIELDS
    k1: float = 1.2
    b: float = 0.75
    # How text is cut into words: "spaced" or "unicode".
    analyzer: str = "spaced"
    fuzzy: bool = True
    max_expansions: int = 50
    rrf_k: int = RRF_K
    rerank_top_k: int = RERANK_TOP_K
    # Requests with a larger limit are refused; retrieval depth follows from it.
    max_limit: int = MAX_LIMIT
    score_digits: int = 6
    # Cells that a query looks at in an index with cells; None searches all vectors.
    probes: int | None = None
    # The bounds below decide between a broadcast and a shuffled plan. They
    # change how a result is computed, never what it is.
    broadcast_rows: int = 2_000_000
    query_block_rows: int = 4_096
    join_salts: int = 32
    # Folders of postings and of fuzzy keys. A query reads those of its terms only;
    # more of them pay off for large indexes, at the price of more files.
    term_partitions: int = 64
    key_partitions: int = 64
    # Up to this many looked-up documents are named to the scan one by one.
    lookup_rows: int = 1_000
    # Rows of vectors that meet a block of queries in one group.
    slice_rows: int = 20_000
    index_buckets: int | None = None

    @property
    def max_depth(self) -> int:
        return max(DEPTH_FACTOR * self.max_limit, MIN_DEPTH)

    def weight(self, field_name: str) -> float:
        return self.field_weights[field_name] * self.mapping_boosts.get(field_name, 1.0)

    def is_keyword(self, field_name: str) -> bool:
        return field_name in self.keyword_fields
