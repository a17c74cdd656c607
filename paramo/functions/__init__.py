"""Column expressions and distributed numeric helpers shared by the operators."""
