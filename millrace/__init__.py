"""Table operators for PySpark."""
