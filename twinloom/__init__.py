"""Parallel-text data engine on Spark DataFrames."""
