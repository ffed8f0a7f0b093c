"""Pipeline jobs and the registered query catalog (Spark builders paired with DuckDB oracle SQL)."""
