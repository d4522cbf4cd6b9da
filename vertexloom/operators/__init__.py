"""Graph operators: DataFrames in, DataFrames out."""
