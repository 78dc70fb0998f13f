"""Spark-native analytics over paged documents (document -> page -> text block)."""
