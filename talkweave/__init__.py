"""Conversation analytics, search and context assembly as Spark DataFrame operators."""

__version__ = "0.1.0"
