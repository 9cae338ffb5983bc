"""Spark-native spatial sample analytics."""
