"""The steps of matching and of downsampling, each a function from DataFrames to DataFrames."""
