"""Sijill: a Spark-native engine for legal and administrative document collections."""

__version__ = "0.1.0"
