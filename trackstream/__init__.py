"""Spark-native analytics for moving fleets and order flows."""
