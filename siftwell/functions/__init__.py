"""Column functions that the operators are made of."""
