"""The models, layer by layer. Each function maps DataFrames to a DataFrame and runs no job."""
