"""Cairnwork streaming."""
