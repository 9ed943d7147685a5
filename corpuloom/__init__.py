"""Corpuloom: a PySpark-native engine for dataset curation and calibration analytics."""

__version__ = "0.1.0"
