"""Gleaner: ranked-slice retrieval and text analytics as Spark DataFrame plans."""

__version__ = "0.2.0"
