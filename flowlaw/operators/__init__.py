"""Operators from DataFrames to DataFrames, or to small summaries."""
