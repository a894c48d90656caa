"""Spark-native analytics over genome-coordinate tables, written as DataFrame programs."""

__version__ = "0.1.0"
