"""Operators for building training data out of web-scale text tables.

Nothing outside this folder imports it; ``queries.py`` lists what it offers.
"""
