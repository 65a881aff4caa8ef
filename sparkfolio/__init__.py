"""A PySpark-native engine for querying documents at scale."""

__version__ = "0.1.0"
