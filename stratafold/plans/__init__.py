"""Compositions of operators: matrices, training, runs."""
