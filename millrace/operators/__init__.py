"""Relational operators: scopes, expressions and the lowering of selects to DataFrames."""
