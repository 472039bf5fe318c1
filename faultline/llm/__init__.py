"""Operators for preparing training text: search, mixing, quality, privacy, duplicates, tokens."""
