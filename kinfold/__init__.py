"""Affinity analytics on Spark: datasets, similarity, ranking and evaluation as DataFrame operators."""
