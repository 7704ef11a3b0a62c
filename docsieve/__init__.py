"""Spark-native analysis of positioned text lines, identity documents and text corpora."""
