"""Spark-native analytics for portfolio research tables."""
