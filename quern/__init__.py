"""Oracle-dialect analytics on PySpark."""
