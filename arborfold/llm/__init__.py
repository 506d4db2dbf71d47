"""Operators on document texts; nothing else in the package imports them."""
