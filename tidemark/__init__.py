"""Spark-native analytics over versioned, range-partitioned tables."""
