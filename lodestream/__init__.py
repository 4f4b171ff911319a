"""Spark-first analytics over document knowledge bases and conversations."""
