"""Spatio-temporal analytics on Spark DataFrames: points and boxes in (t, x, y)."""

__version__ = "0.1.0"
