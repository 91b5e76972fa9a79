"""Prose checking over Spark DataFrames."""
