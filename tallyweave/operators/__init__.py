"""Operators over count tables. Each takes and returns DataFrames."""
