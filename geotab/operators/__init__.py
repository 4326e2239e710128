"""Operators on tables: DataFrames in, DataFrames out."""
