"""Plumbline: supervised machine-learning workflows as Spark DataFrame plans."""

__version__ = "0.1.0"
