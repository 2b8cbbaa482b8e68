"""Operators for preparing training data: tokenisation, deduplication, filtering, scoring.

Nothing else in the library imports this package; it imports only general helpers.
"""
