"""Ebbtide: drawdown-driven portfolio analytics on Spark DataFrames."""
