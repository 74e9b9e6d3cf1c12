"""Hybrid retrieval and ranking over tables of documents and queries."""

from quillrank.config import RetrievalConfig
from quillrank.functions.embedders import HashingEmbedder, ModelEmbedder, ModelScorer, OverlapScorer
from quillrank.plans.evaluation import evaluate
from quillrank.plans.indexing import SearchIndex, apply_changes, bulk_index, rebuild, with_cells
from quillrank.plans.search import hybrid_search, memoised_search, validate
from quillrank.plans.stored_index import open_index, save_index

__all__ = [
    "HashingEmbedder", "ModelEmbedder", "ModelScorer", "OverlapScorer", "RetrievalConfig",
    "SearchIndex", "apply_changes", "bulk_index", "evaluate", "hybrid_search", "memoised_search",
    "open_index", "rebuild", "save_index", "validate", "with_cells",
]
