"""Relational building blocks: filters, joins, aggregates, windows, sets, graphs."""
