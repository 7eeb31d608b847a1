"""Relational operators, DataFrame(s) in and DataFrame out."""
