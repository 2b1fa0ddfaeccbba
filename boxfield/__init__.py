"""Boxfield: point clouds, oriented boxes and layout analytics as Spark DataFrames."""

__version__ = "0.1.0"
