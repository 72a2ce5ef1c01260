"""Lamina: label volumes as relations, analysed with Spark DataFrames."""

__version__ = "0.1.0"
