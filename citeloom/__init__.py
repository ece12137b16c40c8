"""Citation-graph analytics on Spark: every operator is a function from DataFrames to DataFrames."""
