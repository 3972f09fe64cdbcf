"""Cairnwork sources."""
