"""matchloom: a PySpark-native analytics engine for records of two-sided contests."""

__version__ = "0.1.0"
