"""Plans: the study, registered queries, DuckDB oracle SQL, workflow calls."""
