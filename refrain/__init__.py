"""Spark-native detection, alignment and clustering of reused text."""
