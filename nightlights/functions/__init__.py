"""Functions of the nightlights library."""
