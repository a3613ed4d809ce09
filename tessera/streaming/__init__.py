"""streaming of the tessera library."""
