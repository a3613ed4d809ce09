"""functions of the tessera library."""
