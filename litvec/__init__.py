"""Prepare and search document collections with plain PySpark DataFrame functions."""
