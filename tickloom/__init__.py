"""Volume-by-price analytics on Spark DataFrames."""
