"""Table sources: the driver's raw tables, entity tables, change feeds."""
