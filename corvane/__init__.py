"""A retrieval and training-data engine on Spark DataFrames."""
