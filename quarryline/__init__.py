"""Spark-native analytics over governed document collections."""
