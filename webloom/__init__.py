"""Spark-native web observation engine: links, traversal, endpoints, health and source monitoring as DataFrames."""

__version__ = "0.1.0"
