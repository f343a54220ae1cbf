"""Spark-first analytics over symbolic sequences."""
