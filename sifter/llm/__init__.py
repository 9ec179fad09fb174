"""Operators for preparing training data; nothing else in sifter imports this package."""
