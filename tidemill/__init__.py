"""A retrieval-analytics engine on Spark DataFrames."""
