"""apiarium: a PySpark-native engine for API-catalog analytics and corpus preparation."""

__version__ = "0.1.0"
