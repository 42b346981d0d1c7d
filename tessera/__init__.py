"""Spark-native analytics over code facts, service telemetry and training corpora."""
