"""Operators on vectors, graphs, codes and segments."""
