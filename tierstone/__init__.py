"""Layered warehouse and context operators as plain PySpark DataFrame functions."""
