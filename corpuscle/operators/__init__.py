"""Operators of retrieval as functions from DataFrames to DataFrames."""
