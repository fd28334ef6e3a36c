"""Independent DuckDB statements giving the expected rows of each registered query."""
