"""Spark-native analytics over evidence-based program models."""
