"""Time-series strategy analytics on Spark DataFrames."""
