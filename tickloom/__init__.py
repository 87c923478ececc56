"""Spark-native analytics for partitioned price/volume bar series."""
