"""Multi-signal timeline analytics on Spark DataFrames."""
