"""Corpus preparation operators for large training sets; nothing else in the library imports this package."""
