"""Time series of multi-band raster observations as Spark DataFrames."""
