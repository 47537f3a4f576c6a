"""Gridded-data and training-data analytics as Spark DataFrame operators."""
