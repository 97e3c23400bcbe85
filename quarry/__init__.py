"""Spark-native text, graph and event analytics."""
