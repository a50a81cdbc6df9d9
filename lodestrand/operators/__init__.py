"""Operators: from DataFrames to DataFrames, without knowledge of where the rows come from."""
