"""operators of the tessera library."""
