"""tessera: analytics operators for scientific tables, as PySpark DataFrame plans."""
