"""Bitemporal memory engine on Spark DataFrames."""
