"""Spark-native analytics over content-addressed object graphs."""
