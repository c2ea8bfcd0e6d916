"""Spark-native analytics for retrieval corpora and their telemetry."""
