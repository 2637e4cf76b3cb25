"""Tessera: panel, point-in-time and portfolio analytics as lazy Spark plans."""

__version__ = "0.1.0"
