"""Spark-native retrieval and data-processing operators over semi-structured text records."""

__version__ = "0.1.0"
