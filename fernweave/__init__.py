"""Spark-native document retrieval and text analytics."""
