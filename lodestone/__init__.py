"""Lodestone: tabular analysis, cleaning and evidence retrieval on Spark DataFrames."""
