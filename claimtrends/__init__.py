"""Spend trends, risk rules and forecasts for quarterly claims, as Spark DataFrames."""
