"""Change-impact and training-data analytics on Spark DataFrames."""
