"""Operators for preparing training text at cluster scale; nothing else in the library imports them."""
