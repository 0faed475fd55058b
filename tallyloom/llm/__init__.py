"""Operators for training text and item sets; nothing else in the library imports this subpackage."""
