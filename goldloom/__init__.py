"""Spark-native golden-record engine."""
