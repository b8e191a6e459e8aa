"""Florilege: a Spark-native analytics engine for chemical and plant-chemistry tables."""

__version__ = "0.1.0"
