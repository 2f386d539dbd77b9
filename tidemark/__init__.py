"""Tidemark: Spark-native scoring of synthetic time series against real ones."""
