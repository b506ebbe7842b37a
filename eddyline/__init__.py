"""Complex event processing and continuous queries as PySpark DataFrame plans."""
