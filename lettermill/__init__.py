"""Spark-native analytics over message folders, contacts and filing."""
