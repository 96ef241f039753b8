"""tessera functions."""
