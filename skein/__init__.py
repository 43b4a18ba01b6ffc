"""Text mining at corpus scale, as lazy transformations of Spark DataFrames."""
