"""Panel analytics on Spark DataFrames: factors, screens, forward measurement."""

__version__ = "0.1.0"
