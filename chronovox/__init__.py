"""Analytics of points, lineages, voxels and transformations over time, on Spark DataFrames."""
