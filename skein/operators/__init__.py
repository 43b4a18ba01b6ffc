"""Dataset operators: DataFrames in, DataFrame out."""
