"""Operators of the impact graph; each takes and returns DataFrames."""
