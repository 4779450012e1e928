"""Retrieval, graph and planning analytics on Spark DataFrames."""
