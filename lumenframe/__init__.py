"""Keyframe retrieval and the data processing around it, on Spark DataFrames."""
