"""Operators for preparing training data: mixing, formatting, joins, scoring, search and token files."""
