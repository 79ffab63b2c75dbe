"""PySpark-native analytics for multi-channel sensor-array recordings."""

__version__ = "0.1.0"
