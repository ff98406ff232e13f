"""memweave: memory analytics on Spark DataFrames."""
