"""Millrace: an analytics engine that speaks its own SQL dialect and runs on Spark DataFrames."""
