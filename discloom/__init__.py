"""Spark-native analytics over optical-disc audio images."""
