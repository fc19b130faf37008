"""Spark-native document analytics: every operator is a lazy DataFrame transform."""
