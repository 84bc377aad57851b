"""Threadloom: a PySpark-native analytics engine for threaded discussion logs."""

__version__ = "0.1.0"
