"""Spark-native full-text search, ranking and corpus processing."""

__version__ = "0.1.0"
