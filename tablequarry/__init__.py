"""Table-semantics and text-to-SQL data work as PySpark jobs."""
