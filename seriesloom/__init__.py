"""Trend, episode, spectrum, ranking, text-evidence and portfolio operators on Spark DataFrames."""
