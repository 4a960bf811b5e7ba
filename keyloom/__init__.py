"""Keyloom: a PySpark engine for ordered interaction-event sessions and the text they leave."""

__version__ = "0.1.0"
