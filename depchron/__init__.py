"""Dependency-history analytics on Spark DataFrames."""
