"""Spark-native web-log analytics and corpus preparation."""
