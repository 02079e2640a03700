"""Positional full-text search on PySpark DataFrames."""
