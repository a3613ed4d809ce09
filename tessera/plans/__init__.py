"""plans of the tessera library."""
