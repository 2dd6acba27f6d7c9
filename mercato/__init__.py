"""Retail analytics as PySpark DataFrame operators."""
