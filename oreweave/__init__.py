"""Spark-native analytics over code corpora and text corpora."""
