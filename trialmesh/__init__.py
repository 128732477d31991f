"""Operators for iterative mixture experiments, written as Spark DataFrame jobs."""

__version__ = "0.1.0"
