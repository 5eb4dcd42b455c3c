"""Deal-flow knowledge operators on Spark DataFrames and Structured Streaming."""
