"""Column functions of the lexical engine."""
