"""Cairnwork plans."""
