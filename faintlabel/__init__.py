"""Weak-label learning and feature ranking on Spark DataFrames."""

__version__ = "0.1.0"
