"""Spatio-temporal voxel analytics on Spark DataFrames."""
