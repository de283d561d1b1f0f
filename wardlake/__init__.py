"""Governance of AI interactions as Spark jobs over tables and streams."""

__version__ = "0.1.0"
