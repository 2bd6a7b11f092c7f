"""Spark-native analytics of evaluation runs."""
