"""Column functions: text analysis, vectors, keys and edit distance."""
