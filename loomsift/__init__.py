"""Spark-native quality engine for language-model training data."""

__version__ = "0.1.0"
