"""Spark-native near-duplicate matching of ordered sequences of 64-bit codes."""
