"""Operators for the preparation of training text; nothing outside this subpackage imports it."""
