"""Whole jobs: indexing, hybrid search and evaluation."""
