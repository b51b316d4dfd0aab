"""Whole jobs, each chaining the operators."""
