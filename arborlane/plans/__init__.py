"""Whole jobs and reports built from operators."""
