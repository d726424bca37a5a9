"""Column expressions, seeded draws, ranking helpers and distribution functions."""
