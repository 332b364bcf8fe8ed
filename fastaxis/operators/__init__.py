"""Relational operators of the splitting analysis: DataFrames in, DataFrames out."""
