"""Column builders: alphabets, matrices, scalar and set functions."""
