"""Query registry (Spark side) and the independent DuckDB oracle SQL."""
