"""Spark-native keyword mining and content analysis."""
