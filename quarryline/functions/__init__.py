"""Column expressions that the operators are composed of."""
