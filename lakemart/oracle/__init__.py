"""DuckDB oracle SQL: the same questions asked in plain SQL over the driver tables."""
