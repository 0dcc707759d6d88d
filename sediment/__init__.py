"""A versioned key-value engine on Spark DataFrames."""
