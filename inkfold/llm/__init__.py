"""Operators that prepare text for model training; nothing else in the library imports them."""
