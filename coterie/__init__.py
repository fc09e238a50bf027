"""Graph community analytics on Spark DataFrames."""
