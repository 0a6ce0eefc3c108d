"""Spark-native engine for collecting and curating business records."""

__version__ = "0.1.0"
