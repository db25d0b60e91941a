"""Column functions: every one is an expression of built-in functions."""
