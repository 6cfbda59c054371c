"""Exact nearest-neighbour analytics on Spark DataFrames."""
