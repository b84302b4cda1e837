"""Spark-native analytics over source changes, findings and text corpora."""
