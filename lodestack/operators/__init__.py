"""Operators over DataFrames. They take and return plain DataFrames and stay lazy."""
