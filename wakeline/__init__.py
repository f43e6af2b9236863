"""Spark-native storage, querying and analysis of vessel position reports."""
