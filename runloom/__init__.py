"""Spark-first analytics over the data that agent runs leave behind."""

__version__ = "0.1.0"
