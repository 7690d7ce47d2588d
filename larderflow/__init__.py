"""Spark-native recipe-to-shopping-list engine."""
