"""Rare-event risk analytics on a space-time grid, written for Spark DataFrames."""
