"""Spark-native retrieval, graph and evaluation analytics."""
