"""Spark-native document reconciliation engine."""
