"""rungwork: a PySpark-native engine for ranked incidence data."""

__version__ = "0.1.0"
