"""Spark-native search, registry and text processing over governed document corpora."""
