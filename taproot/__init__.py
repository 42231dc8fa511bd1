"""Spark-native analytics for forests of spatial tree skeletons and segmented volumes."""

__version__ = "0.1.0"
