"""Conversation-memory analytics on PySpark."""
