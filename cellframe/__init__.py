"""Temporal rasters, vector features and corpus operators as Spark plans."""
