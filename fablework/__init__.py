"""Narrative knowledge analytics on Spark DataFrames."""
