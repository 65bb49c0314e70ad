"""Sources of the nightlights library."""
