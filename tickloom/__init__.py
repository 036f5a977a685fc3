"""A Spark-native engine for time-series strategy research."""
