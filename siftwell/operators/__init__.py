"""Operators on DataFrames: chunking, nearest neighbours, BM25, hybrid search, snapshot changes."""
