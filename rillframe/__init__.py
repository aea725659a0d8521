"""Analytics operators for tables and event streams on PySpark."""
