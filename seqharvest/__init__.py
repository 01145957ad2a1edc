"""Spark-native average-utility sequence analytics."""
