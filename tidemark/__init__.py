"""Spark-first audience, experiment and training-data analytics."""
