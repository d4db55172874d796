"""Framewright: quality-aware measurement of sensor time series on Spark DataFrames."""
