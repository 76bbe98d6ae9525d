"""Source-quality analytics and corpus operators on Spark DataFrames."""
