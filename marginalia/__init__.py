"""Study-corpus analytics on Spark DataFrames."""
