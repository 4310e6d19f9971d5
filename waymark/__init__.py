"""waymark: vehicle trajectory reconstruction and corpus preparation on Spark DataFrames."""
