"""Game and application telemetry analytics on Spark DataFrames."""
