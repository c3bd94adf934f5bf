"""Operators on DataFrames: cleaning, sampling, selection, forests, votes and metrics."""
