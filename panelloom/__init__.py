"""Market-panel analytics on Spark DataFrames."""
