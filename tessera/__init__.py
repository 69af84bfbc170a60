"""Spark-native portfolio, document-retrieval and corpus analytics."""
