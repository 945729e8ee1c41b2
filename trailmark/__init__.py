"""Spark-native analytics for location check-ins."""
