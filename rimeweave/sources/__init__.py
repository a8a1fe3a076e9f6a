"""Reading irregular measurement files as DataFrames, and writing results."""
