"""Spark-native analytics for large collections of legal documents."""
