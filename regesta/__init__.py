"""Spark-native analytics for contact directories built from open data."""

__version__ = "0.1.0"
