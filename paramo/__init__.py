"""Territorial analytics as PySpark DataFrame and Structured Streaming operators."""
