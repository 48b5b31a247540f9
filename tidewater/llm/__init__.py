"""Operators on training text and item lists; nothing else in the library imports them."""
