"""Audit tabular machine-learning work with Spark DataFrames."""

__version__ = "0.1.0"
