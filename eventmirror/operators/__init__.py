"""Operators: every function takes and returns DataFrames and starts no job, except where it says so."""
