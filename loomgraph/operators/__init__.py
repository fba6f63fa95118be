"""Relational operators: ingest, extraction, merge, graph, vectors, ranking, retrieval."""
