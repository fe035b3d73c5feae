"""Seqloom: sequence analytics on Spark DataFrames."""
