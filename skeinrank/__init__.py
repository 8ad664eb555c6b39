"""Retrieval ranking and learning to rank on Spark DataFrames."""
