"""A Spark-native engine that selects noise models for many time series."""

__version__ = "0.3.0"
