"""Column expressions: randomness, distributions, patterns, scalar functions."""
