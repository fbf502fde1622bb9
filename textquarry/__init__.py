"""Spark-native content analytics: search, near-duplicates, vectors, images, pages and streams."""

__version__ = "0.1.0"
