"""Spark-native engine for document retrieval, code-rule checking, usage metrics and large-table preparation."""

__version__ = "0.1.0"
