"""Retail inventory analytics on Spark: functions from DataFrames to DataFrames."""
