"""From contracts and requests to DataFrames."""
