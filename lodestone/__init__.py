"""Spark-native hybrid search and indexing of source code and text."""

__version__ = "0.2.0"
