"""planeframe: typed, governed data plans lowered to lazy Spark DataFrames."""

__version__ = "0.1.0"
