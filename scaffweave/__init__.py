"""Linked-read scaffolding and corpus preparation on Spark DataFrames."""
