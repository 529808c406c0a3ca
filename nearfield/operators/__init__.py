"""Operators over collections: search, indexes, changes, maintenance."""
