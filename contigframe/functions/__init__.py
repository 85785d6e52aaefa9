"""Column expressions on sequences, token arrays and score arrays."""
