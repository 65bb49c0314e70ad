"""Operators of the nightlights library."""
