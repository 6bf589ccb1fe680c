"""Quire: structural document analytics as Spark DataFrame plans."""
