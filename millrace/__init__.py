"""Typed record pipelines on Spark."""

__version__ = "0.1.0"
