"""Column expressions and small Arrow functions used by the operators."""
