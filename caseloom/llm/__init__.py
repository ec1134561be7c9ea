"""Training-data operators: dedup, joins, tokenising, scoring, packing.

Nothing else in the library imports this package.
"""
