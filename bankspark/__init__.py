"""Spark-native entity-bank engine: validate, compile and scan banks, rewrite, evaluate and prepare corpora."""

__version__ = "0.1.0"
