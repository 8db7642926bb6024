"""Graph analytics over semirings as plain Spark DataFrames."""
