"""Query plans: the stand-in views over the driver tables, the registered
queries and their DuckDB oracle SQL."""
