"""Spark-native signal and stream-graph analytics."""
