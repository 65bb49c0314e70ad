"""Streaming of the nightlights library."""
