"""Operators for building training data from web-scale text; nothing outside this package imports it."""
