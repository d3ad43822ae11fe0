"""Spark-native analytics over corpora of code and text."""

__version__ = "0.1.0"
