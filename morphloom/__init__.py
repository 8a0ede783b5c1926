"""Spark-native subword analytics: vocabularies, merges, encoding and evaluation."""

__version__ = "0.1.0"
