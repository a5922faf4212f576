"""Operators over change events, as transformations of DataFrames."""
