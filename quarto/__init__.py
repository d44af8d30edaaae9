"""Spark-native analytics, retrieval and text processing for document archives."""
