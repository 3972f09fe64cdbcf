"""Cairnwork: code-evidence and training-data analytics written as PySpark jobs."""
