"""Composite pipelines and plan helpers."""
