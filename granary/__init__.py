"""Spark-native text intelligence and selection engine."""
