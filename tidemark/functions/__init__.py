"""Column expressions that states are built of."""
