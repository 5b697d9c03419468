"""Spark-first corpus governance and evaluation engine."""
