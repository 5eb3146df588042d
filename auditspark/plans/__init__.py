"""Compositions of operators: one audit of one table, from raw rows to a graded row."""
