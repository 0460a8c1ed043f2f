"""Spark-native annotation, evaluation and corpus analytics."""

__version__ = "0.1.0"
