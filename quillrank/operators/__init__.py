"""Retrieval, fusion, memo and evaluation steps over DataFrames."""
