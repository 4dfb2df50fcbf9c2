"""Incremental view maintenance on Spark DataFrames."""
