"""Spark-native de-identification and recognition of log lines."""
