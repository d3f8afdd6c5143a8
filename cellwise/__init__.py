"""Grid, site and spatial-feature analytics on Spark DataFrames."""
