"""Spark-native operators for building entity-year, region-year and industry-year research panels."""

__version__ = "0.1.0"
