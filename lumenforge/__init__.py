"""Spark-native preprocessing and analytics for multimodal chat data."""

__version__ = "0.1.0"
