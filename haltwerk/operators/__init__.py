"""Operators: pure functions from DataFrame to DataFrame."""
