"""Spark-native tick analytics and training-data operators."""
