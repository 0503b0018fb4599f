"""Compositions of operators: whole analyses."""
