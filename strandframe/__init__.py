"""Spark-native engine for sequence, record and numeric-series analytics."""

__version__ = "0.1.0"
