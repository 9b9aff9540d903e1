"""Assessment-content analytics on PySpark."""
