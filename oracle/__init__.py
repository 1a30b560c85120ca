"""Independent SQL statements of every registered query, run by DuckDB in the checks."""
