"""Jobs of the nightlights library."""
