"""Spark-native analytics with exact, testable semantics."""

__version__ = "0.1.0"
