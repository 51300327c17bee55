"""Operators of the ordered-table engine."""
