"""Operators for preparing training data out of the exposure tables. Nothing else in the library imports this package."""
