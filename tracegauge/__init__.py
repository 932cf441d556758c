"""Agent-trace analytics on Spark DataFrames."""
