"""Property and market analytics on Spark DataFrames."""
