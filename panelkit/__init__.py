"""panelkit: geospatial panel analytics and forecast verification on Spark DataFrames."""
