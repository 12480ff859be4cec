"""PySpark-native analytics over (symbol, date) panels."""

__version__ = "0.1.0"
