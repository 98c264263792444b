"""Operators: cleaning, joins, ordered analytics, sampling and token arrays."""
