"""Dataset-to-catalogue analytics on Spark DataFrames."""
