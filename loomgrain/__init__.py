"""Spark-native reading of web pages: facts, rows, contracts and drift, as DataFrames."""
