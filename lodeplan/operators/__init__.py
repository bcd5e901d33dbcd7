"""Pipelines as DataFrames: the only place where plans meet Spark's relational API."""
