"""Spark-native trip and event analytics: DataFrame operators, plans and models."""
