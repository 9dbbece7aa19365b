"""Operators: DataFrames in, DataFrames out, built-in functions only."""
