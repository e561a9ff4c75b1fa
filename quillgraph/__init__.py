"""Spark-native retrieval and knowledge-graph analytics."""

__version__ = "0.1.0"
