"""Cairnwork functions."""
