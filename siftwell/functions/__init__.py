"""Column functions: text, lines, numbers and vectors."""
