"""sources of the tessera library."""
