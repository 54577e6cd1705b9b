"""Operators on tables of sequence graphs. Each takes and returns DataFrames, for all graphs and paths at once."""
