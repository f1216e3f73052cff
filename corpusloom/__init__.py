"""Spark-first operators for text corpora, retrieval, evaluation and practice records."""
