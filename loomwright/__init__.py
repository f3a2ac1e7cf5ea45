"""Loomwright: a Spark-native engine for text-corpus and trajectory analytics."""

__version__ = "0.1.0"
