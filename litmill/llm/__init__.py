"""Operators for large training-data collections; nothing else in the library imports this package."""
