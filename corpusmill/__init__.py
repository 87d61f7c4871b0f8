"""Corpus building, indexing, retrieval and evaluation as Spark plans."""
