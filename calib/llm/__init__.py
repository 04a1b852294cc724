"""Operators for preparing training text: encoding, scoring, deduplication, search, mixing."""
