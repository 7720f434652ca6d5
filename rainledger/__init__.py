"""Spark-native analytics for document archives, place-resolved event tables and region panels."""
