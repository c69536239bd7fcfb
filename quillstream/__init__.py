"""Spark-native analytics over columns of text payloads."""
