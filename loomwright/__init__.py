"""Feature building, leak-safe encoding, scoring and ensembling on Spark DataFrames."""
