"""Spark-native analytics over measurements, hierarchies and logs."""
