"""Plan-first analytics on PySpark."""
