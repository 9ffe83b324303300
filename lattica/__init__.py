"""Lattica: grid tables (symbol x time x field) on PySpark."""

__version__ = "0.1.0"
