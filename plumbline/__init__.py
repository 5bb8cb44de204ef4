"""Spark-native spatial, sequence and message-stream analytics."""

__version__ = "0.1.0"
