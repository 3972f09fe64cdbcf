"""Cairnwork operators."""
