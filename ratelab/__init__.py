"""Population-based rate analysis on Spark DataFrames."""
