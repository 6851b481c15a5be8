"""Tidewell: an analytics engine for labelled metric time series on PySpark."""

__version__ = "0.1.0"
