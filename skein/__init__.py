"""Spark-native analytics over code, documents and agent state."""
