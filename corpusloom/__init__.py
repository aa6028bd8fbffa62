"""Corpus analytics on Spark: every operator takes DataFrames and returns a lazy DataFrame."""

__version__ = "0.1.0"
