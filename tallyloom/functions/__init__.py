"""Column expressions that several jobs share."""
