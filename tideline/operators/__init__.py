"""Joins, aggregations, windows and searches over DataFrames."""
