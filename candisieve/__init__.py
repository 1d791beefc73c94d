"""Candidate search, scoring and cohort analytics on Spark DataFrames."""
