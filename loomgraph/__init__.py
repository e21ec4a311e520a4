"""A document knowledge-graph engine on Spark DataFrames."""
