"""Spark-native analytics over gridded, region-structured and text data."""
