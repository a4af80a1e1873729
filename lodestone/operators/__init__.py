"""Operators: DataFrames or columns in, the same out."""
