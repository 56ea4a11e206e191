"""Similarity-graph analytics on PySpark DataFrames."""
