"""annospark: a PySpark-native engine for grounded vision-language annotation data."""

__version__ = "0.1.0"
