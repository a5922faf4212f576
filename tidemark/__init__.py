"""Tidemark: a change-data engine that is declared as Spark DataFrames."""

__version__ = "0.1.0"
