"""Network-flow analytics on PySpark."""
