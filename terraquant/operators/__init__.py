"""Relational, graph and iterative operators on DataFrames."""
