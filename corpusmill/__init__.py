"""Spark-native operators for building, checking and measuring text and proof corpora."""
