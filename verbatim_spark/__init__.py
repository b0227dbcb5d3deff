"""Qualitative text analytics as PySpark DataFrame programs."""
