"""Whole pipelines and the query catalogue."""
