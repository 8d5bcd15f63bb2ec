"""Spark-native analytics for staged pipelines of items, messages and events."""
