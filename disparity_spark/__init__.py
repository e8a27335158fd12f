"""A PySpark-native engine for auditing operational decisions, synthetic data and model probes."""

__version__ = "0.1.0"
