"""Spark-native automatic analysis of business tables."""

__version__ = "0.1.0"
