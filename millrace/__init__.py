"""Data-quality analytics over Spark DataFrames."""
