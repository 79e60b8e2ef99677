"""Spark-native matching of event-contract markets and analytics over their order books."""

__version__ = "0.1.0"
