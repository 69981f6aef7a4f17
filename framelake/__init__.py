"""Media-timeline analytics on Spark DataFrames."""
