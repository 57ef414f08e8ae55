"""Whole plans: rendering, the flagship run and the query registry."""
