"""A sampled-signal analytics engine on PySpark DataFrames."""
