"""Interval alignment and timed-text analytics on Spark DataFrames."""
