"""Operators for preparing training text, each by one stated method. Nothing else in the library imports this package."""
