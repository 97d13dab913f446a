"""Symbol graphs and reachability on Spark DataFrames."""
